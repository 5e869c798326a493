"""N best segmentations of many words at once: Viterbi forward, A-star backward, on arrays.

All words of a group take each step together. The forward pass walks the trie of the
pieces from every place and gives the best score of a way to each place. The
backward search keeps an open list for every word; in each step every word takes its
most promising state (its own score plus the forward score of where it stands) and
grows it by the pieces that end there. As the forward score is exact, each open state stands
for one complete way of exactly that score, and no two for the same, so an open list
of n states is enough for the n best.

Ties: a state found earlier goes first, then the one with the shorter last piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE, LITERAL = 0x2581, 0x10FFFF
#: Cells of a group's lattice (words x places x lengths of pieces).
CELLS = 1 << 20


class Lattice:
    """``scores`` and ``ids`` by piece, ids of the 256 bytes, and the score of a character without a piece."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: list[int], unknown: float):
        letters = sorted({c for p in scores for c in p})
        self.kinds = np.zeros(0x110000, np.int64)  # 0: in no piece
        self.kinds[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        kind = {c: k for k, c in enumerate(letters, 1)}
        self.width = len(letters) + 1
        nodes, keys = {"": 0}, []
        for piece in scores:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(nodes)
                    keys.append(nodes[piece[:k - 1]] * self.width + kind[piece[k - 1]])
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.to = np.array(keys, np.int64)[order], order + 1
        self.top = np.zeros(self.width, np.int64)  # nodes after one letter
        low = self.keys[self.keys < self.width]
        self.top[low] = self.to[:len(low)]
        self.score, self.piece = np.full(len(nodes), -np.inf), np.full(len(nodes), -1, np.int32)
        at = [nodes[p] for p in scores]
        self.score[at], self.piece[at] = list(scores.values()), [ids[p] for p in scores]
        self.longest, self.byte_ids, self.unknown = max(map(len, scores)), byte_ids, unknown

    def groups(self, words: list[str], n: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For groups of ``words`` of like length (none empty): the words, how many ways each has, scores and sizes of the ways, and their ids."""
        words = sorted(words, key=len)
        while words:
            size = min(len(words), 1 << 14)
            while size > 1 and size * (len(words[size - 1]) + 1) * min(self.longest, len(words[size - 1])) > CELLS:
                size = size * 3 // 4
            yield words[:size], *self.search(words[:size], n)
            words = words[size:]

    def search(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of ways, and their scores, sizes and ids in a row; the ways of a word are best first."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes[codes == SPACE] = LITERAL
        codes[codes == 32] = SPACE
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        edges, pieces = self._edges(codes, sizes)
        best = self._forward(edges)
        return self._ids(len(words), *self._backward(edges, pieces, best, sizes, n))

    def _edges(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the pieces by word, place where they end, and length - 1 (score -inf: none)."""
        shape = len(sizes), int(sizes.max()) + 1, min(self.longest, int(sizes.max()))
        scores, pieces = np.full(shape, -np.inf), np.zeros(shape, np.int32)
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(codes)) - (ends - sizes)[word]
        left = sizes[word] - place
        kinds = self.kinds[codes]
        at, node = np.arange(len(codes)), self.top[kinds]
        for length in range(1, shape[2] + 1):
            if length > 1:
                keep = left[at] >= length
                at = at[keep]
                key = node[keep] * self.width + kinds[at + length - 1]
                node = np.searchsorted(self.keys, key)
                node[node == len(self.keys)] = 0
                found = self.keys[node] == key
                node = self.to[node]
            else:
                found = node > 0
            at, node = at[found], node[found]
            own = self.score[node] > -np.inf
            a, k = at[own], node[own]
            scores[word[a], place[a] + length, length - 1] = self.score[k]
            pieces[word[a], place[a] + length, length - 1] = self.piece[k]
        lone = np.flatnonzero(scores[word, place + 1, 0] == -np.inf)
        scores[word[lone], place[lone] + 1, 0] = self.unknown
        pieces[word[lone], place[lone] + 1, 0] = -1 - codes[lone]
        return scores, pieces

    @staticmethod
    def _forward(edges: np.ndarray) -> np.ndarray:
        best = np.full(edges.shape[:2], -np.inf)
        best[:, 0] = 0
        for j in range(1, edges.shape[1]):
            k = min(j, edges.shape[2])
            best[:, j] = (edges[:, j, :k] + best[:, j - k:j][:, ::-1]).max(axis=1)
        return best

    @staticmethod
    def _backward(edges, pieces, best, sizes, n):
        """Complete ways in the order in which they were found: word, score, chain; and the chains: id and next link (-1: none)."""
        m, back = len(sizes), np.arange(1, edges.shape[2] + 1)
        # The open lists: promise, own score, place and chain of each state.
        promise, own = np.full((m, n), -np.inf), np.zeros((m, n))
        place, chain = np.zeros((m, n), np.int64), np.full((m, n), -1, np.int64)
        promise[:, 0], place[:, 0] = best[np.arange(m), sizes], sizes
        links, nexts, count = [], [], 0
        found, complete, busy = np.zeros(m, np.int64), [], np.arange(m)
        while len(busy):
            k = promise[busy].argmax(axis=1)
            some = promise[busy, k] > -np.inf
            busy, k = busy[some], k[some]
            at, score, way = place[busy, k], own[busy, k], chain[busy, k]
            promise[busy, k] = -np.inf
            ended = at == 0
            complete.append((busy[ended], score[ended], way[ended]))
            found[busy[ended]] += 1
            r, at, score, way = busy[~ended], at[~ended], score[~ended], way[~ended]
            start, step = at[:, None] - back, edges[r, at]
            grown = score[:, None] + step
            both = np.concatenate([promise[r], grown + best[r[:, None], np.maximum(start, 0)]], axis=1)
            pick = np.argsort(-both, axis=1, kind="stable")[:, :n]
            row, old, new = np.arange(len(r))[:, None], np.minimum(pick, n - 1), np.maximum(pick - n, 0)
            value = both[row, pick]
            fresh = (pick >= n) & (value > -np.inf)
            i, j = np.nonzero(fresh)
            links.append(pieces[r[i], at[i], new[i, j]])
            nexts.append(way[i])
            ways = chain[r[:, None], old]
            ways[i, j] = count + np.arange(len(i))
            count += len(i)
            own[r] = np.where(fresh, grown[row, new], own[r[:, None], old])
            place[r] = np.where(fresh, start[row, new], place[r[:, None], old])
            promise[r], chain[r] = value, ways
            busy = busy[found[busy] < n]
        return *(np.concatenate(c) for c in zip(*complete)), np.concatenate(links), np.concatenate(nexts)

    def _ids(self, m, word, score, way, links, nexts):
        order = np.argsort(word, kind="stable")
        counts, score, way = np.bincount(word, minlength=m), score[order], way[order]
        number, owner, ids = np.arange(len(way)), [], []
        while len(way):
            ids.append(links[way])
            owner.append(number)
            way = nexts[way]
            number, way = number[way >= 0], way[way >= 0]
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        ids, owner = ids[order], owner[order]
        if (lone := ids < 0).any():
            code = [SPACE if c == LITERAL else c for c in (-1 - ids[lone]).tolist()]
            own = [[self.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in code]
            times = np.ones(len(ids), np.int64)
            times[lone] = list(map(len, own))
            ids, owner, lone = np.repeat(ids, times), np.repeat(owner, times), np.repeat(lone, times)
            ids[lone] = [b for o in own for b in o]
        return counts, score, np.bincount(owner, minlength=len(score)), ids
