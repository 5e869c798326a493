"""SentencePiece encoding and decoding: N-best segmentation over the piece lattice.

A forward Viterbi pass gives for each position the best score of a way to it. That
score is an exact heuristic for a backward A-star search: partial segmentations
grow from the end of the text to its start, the queue is ordered by their score
plus the forward score of where they stand, and so complete ones come out best
first.

White space only leads a piece, so a text falls into chunks (a run of spaces and
the word after it) that no piece crosses, and a segmentation of the text is one
of each chunk. The different chunks of a run of texts are searched together
(``lattice``) and kept for the task; the N best of a text follow
from its chunks' N best by a search over the losses of their alternatives. If a
vocabulary has pieces that cross, texts are one chunk each.

Characters without a piece become byte pieces. Text is not normalised, so
decoding returns it exactly.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heappop, heappush, nsmallest
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import give_back, released
from stockloom.llm.lattice import Lattice
from stockloom.llm.words import chunks, flat

SPACE = "▁"
CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Stands for a SPACE sign of the text itself, which becomes bytes. (A text with this noncharacter decodes it as that sign.)
LITERAL = "\U0010ffff"
#: A character without a piece costs this more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Bytes of chunks that a task keeps between runs of texts, and about how many one takes beside its letters and ways.
KEPT, EACH = 48 << 20, 180
#: Bytes of text that are cut at a time (a longer text is not split), and characters of the chunks that are searched together.
RUN, LONGEST = 1 << 20, 64
#: ``RUN`` and ``KEPT`` where ids stay in the task, which leaves room for more.
LARGE = 4 << 20, 96 << 20
#: Parts of chunks that ``Pieces`` keeps.
PARTS_KEPT = 100_000


LETTER = re.compile(r"[^\W\d_]")
#: Parts of a text that no piece crosses, if pieces mix no letters with other signs.
PARTS = re.compile(f"{SPACE}*[^\\W\\d_]+|{SPACE}*(?:(?!{SPACE})[\\W\\d_])+|{SPACE}+")


def _kind(c: str) -> int:
    return 0 if c == SPACE else 1 if LETTER.match(c) else 2


Way = tuple[float, tuple[int, ...]]


@dataclass
class Pieces:
    """Pieces with scores, from a SentencePiece model with byte fallback."""

    scores: dict[str, float]
    ids: dict[str, int]
    texts: list[bytes]
    byte_ids: list[int]
    prefixes: dict[str, float | None] = field(init=False, default_factory=dict)
    joined: set[tuple[int, int]] = field(init=False, default_factory=set)
    unknown: float = field(init=False)
    known: dict[str, list[Way]] = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        for piece in self.scores:
            self.joined |= {(_kind(x), _kind(y)) for x, y in zip(piece, piece[1:])}
            for k in range(1, len(piece)):
                self.prefixes.setdefault(piece[:k], None)
        self.prefixes |= self.scores
        self.unmixed = self.joined <= {(0, 0), (0, 1), (0, 2), (1, 1), (2, 2)}
        self.separable = not any(SPACE in p.lstrip(SPACE) for p in self.scores)

    @staticmethod
    def read(model: bytes) -> Pieces:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        scores, ids, texts, by_byte = {}, {}, [], {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                by_byte[int(piece[3:5], 16)] = i
                texts.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                texts.append(b"")
            else:
                scores[piece], ids[piece] = sp.get_score(i), i
                texts.append(piece.replace(SPACE, " ").encode())
        if len(by_byte) < 256:
            raise ValueError("the model has no byte pieces")
        return Pieces(scores, ids, texts, [by_byte[b] for b in range(256)])

    def _forward(self, text: str) -> tuple[list[list], list[float]]:
        """The lattice, as edges (start, score) by their ends, and the best score of a way to each place (Viterbi)."""
        size, get, unknown = len(text), self.prefixes.get, self.unknown
        edges: list[list] = [[] for _ in range(size + 1)]
        best = [0.0] + [-math.inf] * size
        for i in range(size):
            at, single = best[i], False
            for j in range(i + 1, size + 1):
                score = get(text[i:j], False)
                if score is None:
                    continue
                if score is False:
                    break
                single |= j == i + 1
                edges[j].append((i, score))
                if at + score > best[j]:
                    best[j] = at + score
            if not single:
                edges[i + 1].append((i, unknown))
                best[i + 1] = max(best[i + 1], at + unknown)
        return edges, best

    def search(self, text: str, n: int) -> list[Way]:
        """The ``n`` best segmentations of ``text`` as one lattice, (score, ids), best first."""
        edges, best = self._forward(text)
        queue, found, count = [(-best[-1], 0, len(text), 0.0, None)], [], 0
        while queue:  # backward A-star; a state's way is a chain to the end of the text
            _, _, at, score, way = heappop(queue)
            if not at:
                found.append((score, self._ids(text, way)))
                if len(found) == n:
                    break
                continue
            for start, s in edges[at]:
                count += 1
                heappush(queue, (-(score + s + best[start]), count, start, score + s, (start, at, way)))
        return found

    def _ids(self, text: str, way) -> tuple[int, ...]:
        ids: list[int] = []
        while way is not None:
            start, end, way = way
            piece = self.ids.get(text[start:end])
            ids += [piece] if piece is not None else [self.byte_ids[b] for b in text[start].replace(LITERAL, SPACE).encode("utf-8", "surrogatepass")]
        return tuple(ids)

    def parts(self, text: str) -> list[str]:
        """``text`` cut where no piece can lie across."""
        if self.unmixed:
            return [text] if text[1:].isalpha() else PARTS.findall(text) or [text]
        cuts = [i for i in range(1, len(text)) if (_kind(text[i - 1]), _kind(text[i])) not in self.joined]
        return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])] if cuts else [text]

    def chunk(self, text: str, n: int) -> list[Way]:
        """The ``n`` best segmentations of a chunk, from those of its parts, which are kept."""
        ways = []
        for part in self.parts(text):
            got = self.known.get(part)
            if got is None or len(got) < n and got[-1] is not None:
                if len(self.known) >= PARTS_KEPT:
                    self.known.clear()
                got = self.search(part, n)
                self.known[part] = got if len(got) == n else [*got, None]  # None: there are no more
            ways.append([w for w in got[:n] if w is not None])
        return ways[0] if len(ways) == 1 else best_of(ways, n)

    def encode(self, text: str, n: int = 1) -> list[Way]:
        """The ``n`` best segmentations of ``text``: (score, ids). An empty text has one, without ids."""
        spaced = marked(text)
        ways = [self.chunk(c, n) for c in (CHUNKS.findall(spaced) if self.separable else [spaced] if spaced else [])]
        return best_of(ways, n) if ways else [(0.0, ())]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "surrogatepass")


def marked(text: str) -> str:
    return text.replace(SPACE, LITERAL).replace(" ", SPACE)


def best_of(parts: list[list[Way]], n: int) -> list[Way]:
    """The ``n`` best choices of one way for each part.

    A choice loses the sum of what its ways lose against their parts' best. Choices
    are searched in the order of their loss; only the n - 1 parts whose second
    way loses least can differ from their best.
    """
    base = sum(p[0][0] for p in parts)
    open_ = [i for _, i in nsmallest(n - 1, ((p[0][0] - p[1][0], i) for i, p in enumerate(parts) if len(p) > 1))]
    out = []
    for lost, choice in choices([[w[0] for w in parts[i]] for i in open_], n):
        rank = {open_[k]: r for k, r in choice}
        out.append((base - lost, tuple(x for i, p in enumerate(parts) for x in p[rank.get(i, 0)][1])))
    return out


def choices(scores: list[list[float]], n: int) -> list[tuple[float, tuple]]:
    """The ``n`` least losses, with the parts (number, rank of the way) that differ from their best.

    ``scores`` are those of each part's ways, best first; parts are in the order of their second way's loss.
    """
    loss = lambda choice: sum(scores[k][0] - scores[k][r] for k, r in choice)
    queue, out, count = [(0.0, 0, ())], [], 0
    while queue and len(out) < n:
        lost, _, choice = heappop(queue)
        out.append((lost, choice))
        for nxt in _after(choice, scores):
            count += 1
            heappush(queue, (loss(nxt), count, nxt))
    return out


def _after(choice, scores):
    """Each choice follows exactly one other: the last part takes its next way, the next part joins, or it takes the last one's place."""
    if not choice:
        if scores:
            yield ((0, 1),)
        return
    k, rank = choice[-1]
    if rank + 1 < len(scores[k]):
        yield (*choice[:-1], (k, rank + 1))
    if k + 1 < len(scores):
        yield (*choice, (k + 1, 1))
        if rank == 1:
            yield (*choice[:-1], (k + 1, 1))


class Table:
    """The ``n`` best ways of chunks, by number, and those of whole texts from them.

    Texts are cut into chunks on arrays. The different chunks of a run that are not known yet are
    searched together (``Lattice``); one of more than ``LONGEST`` characters is searched by itself,
    each part of it that no piece crosses. Kept chunks take about ``kept`` bytes at most between runs.
    """

    def __init__(self, pieces: Pieces, n: int = 2, run: int | None = None, kept: int | None = None):
        self.pieces, self.n, self.run, self.kept = pieces, n, run or RUN, kept or KEPT
        self.lattice = Lattice(pieces.scores, pieces.ids, pieces.byte_ids, pieces.unknown)
        self.lengths = np.array([len(t) for t in pieces.texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(pieces.texts), np.uint8)
        self.empty()

    def empty(self) -> None:
        """Forget all chunks."""
        self.known: dict[str, int] = {}
        self.pieces.known.clear()
        self.used, self.n_lists, self.n_ways, self.n_ids = 0, 0, 0, 0
        self.ids, self.first, self.score = np.zeros(1 << 18, np.int32), np.zeros(1 << 17, np.int64), np.zeros(1 << 17)  # of each way
        self.begin, self.loss = np.zeros(1 << 16, np.int64), np.zeros(1 << 16)  # of each list: its first way, and what its second way loses

    def _add(self, words: list[str], counts: np.ndarray, scores: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """``words`` with their ways: how many each has, and of all ways in a row the scores, numbers of ids and ids."""
        lists, ways, size = self.n_lists + len(words), self.n_ways + len(scores), self.n_ids + len(ids)
        for name, need in (("ids", size), ("first", ways + 1), ("score", ways), ("begin", lists + 1), ("loss", lists)):
            if need > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate([old, np.zeros(need, old.dtype)]))
        self.ids[self.n_ids:size], self.score[self.n_ways:ways] = ids, scores
        self.first[self.n_ways + 1:ways + 1] = self.n_ids + np.cumsum(sizes)
        ends = np.cumsum(counts)
        self.begin[self.n_lists + 1:lists + 1] = self.n_ways + ends
        second = np.minimum(ends - counts + 1, len(scores) - 1)
        self.loss[self.n_lists:lists] = np.where(counts > 1, scores[ends - counts] - scores[second], math.inf)
        self.known.update(zip(words, range(self.n_lists, lists)))
        self.n_lists, self.n_ways, self.n_ids = lists, ways, size
        self.used += sum(map(len, words)) + len(words) * EACH + len(scores) * 16 + len(ids) * 4

    def _numbers(self, words: list[str]) -> np.ndarray:
        if self.used > self.kept:
            self.empty()
        new = [w for w in words if w not in self.known]
        for group in self.lattice.groups([w for w in new if len(w) <= LONGEST], self.n):
            self._add(*group)
        for w in new:
            if len(w) > LONGEST:
                ways = self.pieces.chunk(marked(w), self.n)
                sizes = np.array([len(ids) for _, ids in ways])
                self._add([w], np.array([len(ways)]), np.array([score for score, _ in ways]), sizes, np.array([i for _, ids in ways for i in ids], np.int32))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def runs(self, texts: pa.Array) -> Iterator[tuple[int, list]]:
        """For runs of ``texts``: the first one's row, and the ``n`` best ways of each, or as many as there are: (score, ids), best first. Null has None."""
        for low, run in chunks(texts, self.run):
            if self.pieces.separable:
                yield low, self._run(run)
            else:
                yield low, [None if t is None else [(score, np.array(ids, np.int32)) for score, ids in self.pieces.encode(t, self.n)] for t in run.to_pylist()]

    def _run(self, texts: pa.Array) -> list:
        data, at, buffer = flat(texts)
        cut = data == 32
        cut[1:] &= data[:-1] != 32
        cut[at[:-1][at[:-1] < at[1:]]] = True  # texts start chunks too
        starts = np.flatnonzero(cut)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), buffer).dictionary_encode()
        k = self._numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
        way = self.begin[k]
        start, size, score, loss = self.first[way], self.first[way + 1] - self.first[way], self.score[way], self.loss[k]
        ids = gathered(self.ids, start, size)
        upto, ends = np.searchsorted(starts, at), np.append(0, np.cumsum(size))
        return [self._text(ids[ends[a]:ends[b]], k[a:b], size[a:b], score[a:b], loss[a:b]) if valid else None
                for a, b, valid in zip(upto[:-1].tolist(), upto[1:].tolist(), texts.is_valid().to_pylist())]

    def _text(self, best: np.ndarray, k: np.ndarray, size: np.ndarray, score: np.ndarray, loss: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """Ways of a text, from its best one and its chunks' numbers, sizes, scores and losses. An empty text has one, without ids."""
        total = float(score.sum())
        if not len(k) or self.n == 1:
            return [(total, best)]
        # Only the n - 1 chunks whose second way loses least can differ from their best.
        open_ = [int(loss.argmin())] if self.n == 2 else np.argsort(loss, kind="stable")[:self.n - 1].tolist()
        open_ = [i for i in open_ if loss[i] < math.inf]
        ways = [self[k[i]] for i in open_]
        out, ends = [], None
        for lost, choice in choices([[x[0] for x in p] for p in ways], self.n):
            ids = best
            if choice:
                ends = np.cumsum(size) if ends is None else ends
                cut, at = [], 0
                for i, way in sorted(((open_[c], ways[c][r][1]) for c, r in choice), key=lambda x: x[0]):
                    cut += [best[at:ends[i] - size[i]], way]
                    at = ends[i]
                ids = np.concatenate([*cut, best[at:]])
            out.append((total - lost, ids))
        return out

    def __getitem__(self, k: int) -> list[tuple[float, np.ndarray]]:
        return [(float(self.score[w]), self.ids[self.first[w]:self.first[w + 1]]) for w in range(self.begin[k], self.begin[k + 1])]

    def encode_ways(self, text: str) -> list[tuple[float, np.ndarray]]:
        """The ways of one text."""
        return next(self.runs(pa.array([text], pa.string())))[1][0]

    def encode(self, text: str) -> tuple[np.ndarray, float, float]:
        """Best ids, their score, and the n-th best's score (-inf if there is none)."""
        found = self.encode_ways(text)
        return found[0][1], found[0][0], found[self.n - 1][0] if len(found) >= self.n else -math.inf

    def decoded(self, ids: np.ndarray) -> bytes:
        return gathered(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``values`` one after another."""
    ends = np.cumsum(lengths)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


@lru_cache(maxsize=2)
def _table(model: bytes, n: int, *sizes: int) -> Table:
    return Table(_pieces(model), n, *sizes)


@contextmanager
def _task_table(model: bytes, n: int, *sizes: int) -> Iterator[Table]:
    """The worker's table, emptied when the task ends: workers are used again by other stages."""
    table = _table(model, n, *sizes)
    try:
        yield table
    finally:
        table.empty()
        give_back()


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces.read(model)


def segment(docs: DataFrame, model_path: str, n: int = 2, all_ways: bool = False) -> DataFrame:
    """``docs`` with ids (array of int), score, next_score, decoded, and with ``all_ways`` also ways.

    ``score`` is that of the best segmentation of ``text``, ``next_score`` that of the
    n-th best (null where there are fewer); ``decoded`` is the text back from ids.
    ``ways`` are the n best (score, ids), or as many as there are, best first.
    A null text has null ids, scores, decoded and ways; an empty text one way, without ids and of score 0.
    Columns of these names are replaced. ``model_path`` is read by the driver only.
    """
    docs = docs.drop("ids", "score", "next_score", "decoded", *(["ways"] if all_ways else []))
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    kinds = {"ids": "array<int>", "score": "double", "next_score": "double", "decoded": "string", "ways": "array<struct<score: double, ids: array<int>>>"}
    if not all_ways:
        del kinds["ways"]
    schema = docs.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()}).schema
    names = schema.names
    lists = pa.list_(pa.int32())

    def lists_of_ways(found):
        flat = [w for f in found for w in f or ()]
        ends = np.cumsum([0, *(len(f or ()) for f in found)]).tolist()
        ways = pa.StructArray.from_arrays([pa.array([w[0] for w in flat], pa.float64()), pa.array([w[1] for w in flat], lists)], names=["score", "ids"])
        return pa.ListArray.from_arrays(pa.array([None if f is None else e for f, e in zip(found, ends)] + ends[-1:], pa.int32()), ways)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _task_table(model.value, n) as table:
            yield from pieces_of(batches, table)

    def pieces_of(batches: Iterator[pa.RecordBatch], table: Table) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, found in table.runs(b.column("text")):  # a batch of long texts is put out in parts
                part = b.slice(at, len(found))
                best = [None if f is None else f[0] for f in found]
                ids, score = [f and f[1] for f in best], [f and f[0] for f in best]
                nxt = [f[n - 1][0] if f is not None and len(f) >= n else None for f in found]
                text = [None if x is None else table.decoded(x).decode("utf-8", "surrogatepass") for x in ids]
                columns = [pa.array(ids, lists), pa.array(score, pa.float64()), pa.array(nxt, pa.float64()), pa.array(text, pa.string())]
                if all_ways:
                    columns.append(lists_of_ways(found))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=names)

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, model_path: str, n: int = 2) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the best ids as little-endian 32-bit integers), score, next_score, exact, ways_crc32 per row.

    As ``segment``, but ids stay in the task, and chunks that were searched before are only
    looked up. ``exact`` is whether decoding gave the text back; ``ways_crc32`` are those of the n best
    segmentations, or as many as there are. A null text has no pieces and no ways, and is exact.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    crc = lambda ids: zlib.crc32(ids.astype("<i4").tobytes())

    def row(text: str | None, ways: list | None, table: Table):
        if text is None:
            return 0, 0, None, None, True, []
        score, ids = ways[0]
        sums = [crc(w[1]) for w in ways]
        return len(ids), sums[0], score, ways[n - 1][0] if len(ways) >= n else None, table.decoded(ids) == text.encode("utf-8", "surrogatepass"), sums

    kinds = {"n_pieces": pa.int64(), "ids_crc32": pa.int64(), "score": pa.float64(), "next_score": pa.float64(), "exact": pa.bool_(), "ways_crc32": pa.list_(pa.int64())}

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _task_table(model.value, n, *LARGE) as table:
            for b in batches:
                for at, ways in table.runs(b.column("text")):
                    part = b.slice(at, len(ways))
                    found = list(zip(*[row(t, w, table) for t, w in zip(part.column("text").to_pylist(), ways)]))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(v, k) for v, k in zip(found, kinds.values())]], names=["doc_id", *kinds])

    schema = docs.select("doc_id").withColumns({"n_pieces": F.lit(0).cast("long"), "ids_crc32": F.lit(0).cast("long"), "score": F.lit(None).cast("double"), "next_score": F.lit(None).cast("double"), "exact": F.lit(True), "ways_crc32": F.lit(None).cast("array<bigint>")}).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)
