"""Byte-level BPE ids of whole texts, with each different word of a batch encoded once.

A text is cut before each space and line feed, and between an ASCII letter or digit and
an ASCII sign. Where such a gap stands alone, no token reaches over the cut (the pre-tokenizer
ends letters and digits at a sign), so the ids of a text are those of its words in a row. The
different words of a batch are found by Arrow and encoded by the tokenizer itself; all
else is done on arrays. Texts where that does not hold are encoded as a whole: gaps
that touch, white space of another kind, and strings of added tokens.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Bytes of words that a worker keeps between batches, and about how many one takes beside its letters.
KEPT, EACH = 160 << 20, 170
#: Bytes of text that are cut at a time (a longer text is not split).
CHUNK = 8 << 20
#: Bytes of white space other than space and line feed, and what follows a first byte of wider white space.
CONTROLS = [9, 11, 12, 13, 28, 29, 30, 31]
WIDE = {0xC2: [(0x85,), (0xA0,)], 0xE1: [(0x9A, 0x80)], 0xE2: [*((0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F)], 0xE3: [(0x80, 0x80)]}

#: Per byte, whether it is an ASCII letter or digit, and whether it is another visible ASCII character.
ALNUM = np.array([chr(x).isalnum() and x < 128 for x in range(256)])
SIGN = np.array([32 < x < 127 and not chr(x).isalnum() for x in range(256)])


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places first[0] .. first[0] + size[0] - 1, first[1] .. and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    """Bytes of all texts in a row (null: empty), the place where each starts, and the buffer."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64), pa.py_buffer(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = (texts.buffers()[2] or pa.py_buffer(b"")).slice(int(at[0]), int(at[-1] - at[0]))
    return np.frombuffer(data, np.uint8), at - at[0], data


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``size`` bytes, each with its first row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, "right")))
        yield low, texts.slice(low, high - low)
        low = high


class Encoder:
    """Ids of texts by a byte-level tokenizer file's contents."""

    def __init__(self, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_str(model)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes, self.n, self.n_ids = 0, 0, 0
        self.first, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)  # first[k] to first[k + 1]: ids of word k

    def _keep(self, words: list[str]) -> None:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        n, n_ids = self.n + len(words), self.n_ids + int(sizes.sum())
        for name, need in (("first", n + 1), ("ids", n_ids)):
            if need > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate([old, np.zeros(need, old.dtype)]))
        self.ids[self.n_ids:n_ids] = np.fromiter(chain.from_iterable(found), np.uint32, n_ids - self.n_ids)
        self.first[self.n + 1:n + 1] = self.n_ids + np.cumsum(sizes)
        self.known.update(zip(words, range(self.n, n)))
        self.bytes += sum(map(len, words)) + len(words) * EACH
        self.n, self.n_ids = n, n_ids

    def _numbers(self, words: list[str]) -> np.ndarray:
        if self.bytes > KEPT:
            self._empty()
        k = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(k < 0)
        if len(new):
            k[new] = np.arange(self.n, self.n + len(new))
            self._keep([words[i] for i in new.tolist()])
        return k

    def _odd(self, texts: pa.Array, data: np.ndarray, at: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Which texts have to be encoded as a whole."""
        touching = np.flatnonzero(gap[1:] & gap[:-1]) + 1
        places = [touching[~np.isin(touching, at)], np.flatnonzero(np.isin(data, CONTROLS))]
        for lead, rest in WIDE.items():
            p = np.flatnonzero(data == lead)
            if len(p):  # a first byte is never the last of a text
                after = [data[np.minimum(p + k, len(data) - 1)] for k in (1, 2)]
                places += [p[np.logical_and.reduce([a == b for a, b in zip(after, tail)])] for tail in rest]
        out = np.zeros(len(texts), bool)
        out[np.searchsorted(at, np.concatenate(places), "right") - 1] = True
        for token in self.added:
            out |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        return out

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at, buffer = flat(texts)
        gap = (data == 32) | (data == 10)
        odd = self._odd(texts, data, at, gap)
        if odd.any():
            whole = [np.array(self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids, np.uint32) for t in texts.filter(pa.array(odd))]
            rest, ends = self._cut(texts.filter(pa.array(~odd)))
            parts, sizes = iter(np.split(rest, ends[:-1])) if len(ends) else iter(()), iter(whole)
            out = [next(sizes) if x else next(parts) for x in odd]
            return np.concatenate(out), np.cumsum([len(x) for x in out])
        gap[1:] |= SIGN[data[1:]] & ALNUM[data[:-1]]
        gap[at[:-1][at[:-1] < at[1:]]] = True  # texts start words too
        starts = np.flatnonzero(gap)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        cuts = np.append(starts, len(data)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), buffer).dictionary_encode()
        k = self._numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        first, size = self.first[k], self.first[k + 1] - self.first[k]
        upto = np.append(0, np.cumsum(size))
        return self.ids[ragged(first, size)], upto[np.searchsorted(starts, at[1:])]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts: the first one's row, all their ids, and where each text's ids end. Null is empty."""
        for low, run in chunks(texts):
            yield low, *self._cut(run)


@lru_cache(maxsize=1)
def encoder(model: str) -> Encoder:
    """One for each worker process; what it keeps is bounded by ``KEPT``."""
    return Encoder(model)
