"""Removal of byte strings that occur more than once, by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts at another
place, in the same text or any other.

Anchors. In every window of ``length`` bytes, the grams of GRAM bytes with the least
hash are anchors (winnowing). Equal windows have equal anchors at equal places, so
two occurrences of a window always share an anchor hash. An anchor's *region* is
all windows that hold it, at most 2 * length - GRAM bytes. Only anchor rows (two
hashes and a place) are shuffled, and equal regions of a batch leave as one row.

Shards. Where an anchor hash occurs with equal regions, those are repeats as they
stand. Its different regions, each once, go to one shard, where a suffix array
over them is built by Larsson-Sadakane refinement; Kasai's common prefixes cut it
into classes of equal strings of ``length`` bytes; a class with two or more different
places is a repeat. An anchor with more regions than a suffix array should hold is
spread over several; their classes are merged by binary search in the sorted
signatures of their strings: inside a task up to TASK regions, beyond that
after another shuffle by signature.

A text is known by its hash and its length. Equal texts are one text that occurs
several times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import free_name, released, stage

LENGTH = 200
#: Bytes of texts hashed at once, and of regions in one suffix array (half as many more where they do not divide evenly).
GROUP, SHARD = 1 << 20, 400_000
#: Regions of one anchor that one task takes.
TASK = 16384
U = np.uint64


def gram_of(length: int) -> int:
    """Largest power of two up to a third of the window."""
    return 1 << ((length // 3).bit_length() - 1)


def _table() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)


TABLE = _table()


def _sliding(x: np.ndarray, width: int, take) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = take(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return take(x[:-rest], x[rest:]) if rest else x


def anchors(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors in ``buffer``, which holds texts from ``starts`` to ``ends``."""
    gram = gram_of(length)
    width = length - gram + 1
    if len(buffer) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, size = TABLE[buffer], 1
    while size < gram:
        h = h[:-size] * U(0x9E3779B97F4A7C15 + 2 * size) + h[size:]
        size *= 2
    h ^= h >> U(31)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h |= U(1)
    least = _sliding(h, width, np.minimum)
    edge = np.zeros(len(buffer) + 1, np.int32)
    long = ends - starts >= length
    edge[starts[long]] = 1
    edge[ends[long] - length + 1] -= 1
    least[np.cumsum(edge[: len(least)]) == 0] = 0  # windows that no text has
    pad = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h)
    return places, h[places]


def _text_anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of one long text, in pieces that overlap by a window."""
    found = []
    for at in range(0, max(1, len(text) - length + 1), GROUP):
        piece = text[at:at + GROUP + length - 1]
        places, h = anchors(piece, np.array([0]), np.array([len(piece)]), length)
        found.append((places + at, h))
    places, h = (np.concatenate(x) for x in zip(*found))
    places, first = np.unique(places, return_index=True)
    return places, h[first]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals; runs that touch are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[new[1:], True]]


ROW = "anchor long, region long, hash long, size int, start int, end int, twin boolean, covered boolean"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def _rows(anchor, region, key, size, start, end, twin, covered: bool) -> pa.RecordBatch:
    n = len(start)
    return pa.RecordBatch.from_arrays([
        pa.array(np.asarray(anchor).astype(np.uint64).view(np.int64)), pa.array(np.asarray(region).astype(np.uint64).view(np.int64)), pa.array(np.asarray(key, np.int64)),
        pa.array(np.asarray(size, np.int32)), pa.array(np.asarray(start, np.int32)), pa.array(np.asarray(end, np.int32)), pa.array(np.asarray(twin, bool)), pa.array(np.full(n, covered)),
    ], names=NAMES)


def _find(length: int):
    """Texts to anchor rows; rows with ``covered`` are runs that are known to go, dealt out by the text's hash."""
    gram = gram_of(length)

    def group(keys: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        joined = b"".join(texts)
        buffer = np.frombuffer(joined, np.uint8)
        places, h = _text_anchors(buffer, length) if len(texts) == 1 else anchors(buffer, starts, ends, length)
        if not len(places):
            return
        doc = np.searchsorted(starts, places, "right") - 1
        left = np.maximum(starts[doc], places + gram - length)
        right = np.minimum(ends[doc], places + length)
        digest = xxhash.xxh3_64_intdigest
        region = np.array([digest(joined[a:b], c) for a, b, c in zip(left.tolist(), right.tolist(), (places - left).tolist())], np.uint64)
        order = np.lexsort((region, h))
        h, region, doc, left, right = h[order], region[order], doc[order], left[order], right[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (region[1:] != region[:-1])]
        twin = ~new | ~np.r_[new[1:], True]
        keys_ = np.array(keys, np.int64)
        own, a, b = doc[new], left[new] - starts[doc[new]], right[new] - starts[doc[new]]
        yield _rows(h[new], region[new], keys_[own], sizes[own], a, b, twin[new], False)
        again = doc[~new]
        a, b = merged(left[~new] + again, right[~new] + again)  # moved on by the text's number, so that runs of two texts do not touch
        if len(a):
            own = np.searchsorted(starts + np.arange(len(starts)), a, "right") - 1
            base = starts[own] + own
            # Copies have the same runs: each once.
            key, size, a, b = np.unique(np.stack([keys_[own], sizes[own], a - base, b - base]), axis=1)
            yield _rows(key.view(np.uint64), np.zeros(len(a)), key, size, a, b, np.ones(len(a), bool), True)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, held = [], [], 0
            for key, text in zip(batch.column("hash").to_pylist(), batch.column("raw")):
                text = text.as_py()
                if text is None or len(text) < length:
                    continue
                if texts and held + len(text) > GROUP:
                    yield from group(keys, texts)
                    keys, texts, held = [], [], 0
                keys.append(key)
                texts.append(text)
                held += len(text)
            if texts:
                yield from group(keys, texts)

    return run


@released
def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and region to runs that go (``covered``), and each different region of an anchor that has several.

    A stream: only the last region's first row is carried over, with ``region`` set to
    1 while an earlier region of its anchor has been seen.
    """
    carry = None
    for batch in batches:
        x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in NAMES}
        known = x["covered"]
        if known.any():
            yield batch.filter(pa.array(known))
            x = {c: v[~known] for c, v in x.items()}
        if not len(x["anchor"]):
            continue
        earlier = np.zeros(len(x["anchor"]), bool)
        if carry is not None:
            earlier = np.r_[carry.pop("earlier"), earlier]
            x = {c: np.concatenate([carry[c], x[c]]) for c in NAMES}
        new = np.r_[True, (x["anchor"][1:] != x["anchor"][:-1]) | (x["region"][1:] != x["region"][:-1])]
        heads = np.flatnonzero(new)
        twin = np.logical_or.reduceat(x["twin"], heads) | (np.diff(np.r_[heads, len(new)]) > 1)
        anchor = x["anchor"][heads]
        before = np.r_[earlier[0], anchor[1:] == anchor[:-1]]
        carry = {c: x[c][heads[-1:]] for c in NAMES} | {"twin": twin[-1:], "earlier": before[-1:]}
        rest = ~new  # all but the first row of a region go as they are
        if rest.any():
            yield _take(x, np.flatnonzero(rest), True)
        done = slice(0, len(heads) - 1)
        after = np.r_[anchor[1:] == anchor[:-1], False][done]
        yield from _heads(x, heads[done], twin[done], before[done] | after)
    if carry is not None:
        yield from _heads(carry, np.array([0]), carry["twin"], carry["earlier"])


def _take(x, i, covered: bool) -> pa.RecordBatch:
    return _rows(x["anchor"][i].view(np.uint64), x["region"][i].view(np.uint64), x["hash"][i], x["size"][i], x["start"][i], x["end"][i], x["twin"][i], covered)


def _heads(x, heads, twin, several) -> Iterator[pa.RecordBatch]:
    x = dict(x)
    full = np.zeros(len(x["anchor"]), bool)
    full[heads] = twin
    x["twin"] = full
    if twin.any():
        yield _take(x, heads[twin], True)
    if several.any():
        yield _take(x, heads[several], False)


class Shard:
    """Suffix array over the regions of a shard, laid out with eight zero bytes after each."""

    def __init__(self, regions: list[bytes], length: int):
        self.length = length
        sizes = np.array([len(r) for r in regions], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 8)])[:-1]  # below 2 ** 31, as all places
        self.ends = self.starts + sizes
        self.text = np.frombuffer(b"".join(r + b"\0" * 8 for r in regions) + b"\0" * 8, np.uint8)
        n = len(self.text) - 8
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 8)
        self.end = self.ends.astype(np.int32)[self.row]
        word = self.text.astype(np.uint64)
        for size in (1, 2, 4):  # the eight bytes from each place, first byte highest
            word = (word[:-size] << U(8 * size)) | word[size:]
        self.word = word
        self.order = self._sorted(np.flatnonzero(np.arange(n) < self.end))
        self.common = self._kasai()

    def _sorted(self, places: np.ndarray) -> np.ndarray:
        """Larsson-Sadakane: groups of suffixes equal in h bytes are refined by the rank of what follows, with h doubling.

        Keys and indexes are packed into one number, which sorts much faster than an
        index by key. Bytes are coded densely, from 1; 0 is the end of a region.
        """
        n, longest = len(self.end), int((self.ends - self.starts).max())
        bits = n.bit_length()
        real = np.arange(n) < self.end
        present = np.bincount(self.text[:n][real], minlength=256) > 0
        width = int(present.sum()).bit_length()
        h = min(8, max(1, (63 - bits) // width))
        code = np.zeros(n + 8, np.int64)
        code[:n][real] = np.cumsum(present)[self.text[:n][real]]
        key = np.zeros(n, np.int64)
        for k in range(h):
            key = (key << width) | code[k:k + n]
        key, order = self._by(key[places], places, bits)
        order = order.astype(np.int32)
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank = np.zeros(n + 1, np.int32)
        rank[order] = group + 1  # 0 is the end of a region
        open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))  # groups of one are done
        group, at = group[open_], order[open_]
        while h < longest:
            more = at + h <= self.end[at]  # and so are groups that are equal to the ends of their regions
            open_, group, at = open_[more], group[more], at[more]
            if not len(open_):
                break
            key, by = self._by((group << bits) | rank[at + h], np.arange(len(at)), bits)
            order[open_] = at = at[by]
            split = np.r_[True, key[1:] != key[:-1]]
            group = open_[np.flatnonzero(split)[np.cumsum(split) - 1]]
            rank[at] = group + 1
            more = ~(split & np.r_[split[1:], True])
            open_, group, at = open_[more], group[more], at[more]
            h *= 2
        return order  # equal suffixes stay in the order of their places, as Kasai's bound asks: each sort leaves equal keys as they were

    @staticmethod
    def _by(key: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order with their values (of up to ``bits`` bits), equal keys by value."""
        if 3 * bits <= 63:
            packed = np.sort((key << bits) | value)
            return packed >> bits, packed & ((1 << bits) - 1)
        by = np.lexsort((value, key))
        return key[by], value[by]

    def _kasai(self) -> np.ndarray:
        """Common prefix of each suffix of at least ``length`` bytes with the one before it in order, up to ``length``; else 0.

        Along a region a common prefix is at least one less than that of the place
        before; all regions go along at once.
        """
        before = np.full(len(self.end) + 1, -1, np.int32)
        before[self.order[1:]] = self.order[:-1]
        out = np.zeros(len(self.end) + 1, np.int16 if self.length < 1 << 15 else np.int64)
        by_size = np.argsort(self.starts - self.ends, kind="stable")
        starts, ends = self.starts[by_size], self.ends[by_size]
        sizes = ends - starts - self.length + 1  # suffixes shorter than ``length`` are in no class
        common = np.zeros(len(starts), np.int64)
        for t in range(max(0, int(sizes[0]))):
            live = np.searchsorted(-sizes, -t, "left")
            i, common = starts[:live] + t, np.maximum(common[:live] - 1, 0)
            j = before[i]
            limit = np.where(j >= 0, np.minimum(np.minimum(ends[:live] - i, self.end[np.maximum(j, 0)] - j), self.length), 0)
            common = np.minimum(common, limit)
            for step, values in ((8, self.word), (1, self.text)):
                go = np.flatnonzero(common + step <= limit)
                while len(go):
                    go = go[values[i[go] + common[go]] == values[j[go] + common[go]]]
                    common[go] += step
                    go = go[common[go] + step <= limit[go]]
            out[i] = common
        return out[self.order]

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(places in order, first of each class): suffixes of at least ``length`` bytes, classed by their first ``length``."""
        # A shorter suffix that is equal to long ones in all of its own bytes stands before them, so it tears no class.
        long = self.end[self.order] - self.order >= self.length
        tear = np.cumsum(self.common < self.length)[long]
        return self.order[long], np.flatnonzero(np.r_[True, tear[1:] != tear[:-1]]) if long.any() else np.empty(0, np.int64)

    def signatures(self, places: np.ndarray) -> np.ndarray:
        text = self.text.tobytes()
        return np.array([xxhash.xxh3_64_intdigest(text[p:p + self.length]) for p in places.tolist()], np.uint64)


def _repeated(places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per suffix in order: does its class hold two different places?"""
    if not len(first):
        return np.zeros(0, bool)
    several = np.minimum.reduceat(places, first) != np.maximum.reduceat(places, first)
    return np.repeat(several, np.diff(np.r_[first, len(places)]))


def divided(rows: list[tuple]) -> list[list[tuple]]:
    """``rows`` (the last field is a region) in parts of about ``SHARD`` bytes; no part is much smaller than others, as each costs a merge with the rest."""
    upto = np.cumsum([len(r[-1]) for r in rows])
    count = max(1, round(int(upto[-1]) / SHARD))
    cuts = np.searchsorted(upto, upto[-1] * np.arange(1, count) / count, "right").tolist()
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)]) if a < b]


RUN = "hash long, size int, start int, end int, signature long, several boolean"


def _runs(key, size, starts, ends, signature=None, several=None) -> pa.RecordBatch:
    n = len(starts)
    signature = pa.nulls(n, pa.int64()) if signature is None else pa.array(signature.view(np.int64))
    several = np.zeros(n, bool) if several is None else several
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(key, np.int64)), pa.array(np.asarray(size, np.int32)), pa.array(np.asarray(starts, np.int32)),
                                       pa.array(np.asarray(ends, np.int32)), signature, pa.array(several)], names=[c.split()[0] for c in RUN.split(", ")])


def _search(length: int):
    """Regions sorted by anchor and salt to runs that go; strings of an anchor of several salts leave with their signature."""

    def shard(rows: list[tuple]) -> tuple:
        s = Shard([r[-1] for r in rows], length)
        places, first = s.classes()
        row = s.row[places]
        at = np.array([r[2] for r in rows], np.int64)[row] + places - s.starts[row]
        text = {}
        number = np.array([text.setdefault(r[:2], len(text)) for r in rows], np.int64)[row]
        return s, places, first, row, at, number << 32 | at

    def put(rows, s: Shard, places, flags) -> pa.RecordBatch:
        marked = np.zeros(len(s.end), bool)
        marked[places[flags]] = True
        places = np.flatnonzero(marked)
        places = places[~np.array([r[3] for r in rows], bool)[s.row[places]]]  # regions with a twin go whole already
        row = s.row[places]
        at = np.array([r[2] for r in rows], np.int64)[row] + places - s.starts[row]
        new = np.r_[True, (row[1:] != row[:-1]) | (at[1:] > at[:-1] + length)][: len(row)]
        last = np.r_[new[1:], True][: len(row)]
        own = row[new]
        return _runs([rows[i][0] for i in own], [rows[i][1] for i in own], at[new], at[last] + length)

    def solve(rows: list[tuple], salted: bool) -> Iterator[pa.RecordBatch]:
        parts = divided(rows)
        if len(parts) == 1 and not salted:
            s, places, first, _, _, place = shard(rows)
            yield put(rows, s, places, _repeated(place, first))
            return
        done = []
        for p in parts:
            s, places, first, row, at, place = shard(p)
            found = _repeated(place, first)
            signs = s.signatures(places[first])
            key = np.array([r[0] for r in p], np.int64)[row]
            order = np.argsort(signs)
            done.append((p, s, places, row, at, found, key, np.repeat(signs, np.diff(np.r_[first, len(places)])), signs[order], first[order]))
        for k, (p, s, places, row, at, found, key, signs, *_) in enumerate(done):
            flags = found.copy()
            for _, _, _, _, at2, found2, key2, _, sorted2, first2 in done[:k] + done[k + 1:]:
                if len(sorted2):  # merge: is the string in the other shard's sorted signatures, and at another place?
                    i = np.minimum(np.searchsorted(sorted2, signs), len(sorted2) - 1)
                    c = first2[i]
                    flags |= (sorted2[i] == signs) & (found2[c] | (key2[c] != key) | (at2[c] != at))
            yield put(p, s, places, flags)
            if salted:
                _, once = np.unique(signs, return_index=True)
                yield _runs(key[once], [p[i][1] for i in row[once]], at[once], at[once] + length, signs[once], flags[once])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last, held = [], None, 0
        for batch in batches:
            for anchor, salt, key, size, start, twin, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "salt", "hash", "size", "start", "twin", "raw"))):
                if last is not None and (anchor, salt) != last and (held >= SHARD or salt >= 0 or last[1] >= 0):
                    yield from solve(rows, last[1] >= 0)
                    rows, held = [], 0
                last = anchor, salt
                rows.append((key, size, start, twin, raw))
                held += len(raw)
        if rows:
            yield from solve(rows, last[1] >= 0)

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(offsets, fields) of a column of lists of structs; null lists are empty."""
    sizes = np.diff(column.offsets.to_numpy()) * ~column.is_null().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    fields = {flat.type.field(i).name: flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)}
    return np.concatenate([[0], np.cumsum(sizes)]), fields


@released
def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of texts: one row each, with its bytes."""
    for batch in batches:
        offsets, wanted = _lists(batch.column("wanted"))
        for at in range(0, batch.num_rows, 200):
            rows = range(at, min(at + 200, batch.num_rows))
            part = slice(offsets[rows[0]], offsets[rows[-1] + 1])
            own = np.repeat(np.arange(len(rows)), np.diff(offsets[rows[0]:rows[-1] + 2]))
            texts = [x.as_py() for x in batch.column("raw").slice(at, len(rows))]
            cut = [texts[i][a:b] for i, a, b in zip(own.tolist(), wanted["start"][part].tolist(), wanted["end"][part].tolist())]
            both = {c: batch.column(c).slice(at, len(rows)).to_numpy()[own] for c in ("hash", "size")}
            yield pa.RecordBatch.from_arrays([
                pa.array(wanted["anchor"][part]), pa.array(wanted["salt"][part]), pa.array(both["hash"]), pa.array(both["size"]),
                pa.array(wanted["start"][part]), pa.array(wanted["twin"][part]), pa.array(cut, pa.binary()),
            ], names=["anchor", "salt", "hash", "size", "start", "twin", "raw"])


def repeats(docs: DataFrame, length: int = LENGTH, task: int = TASK) -> DataFrame:
    """Per text of ``docs`` (doc_id, hash, size, raw) that has any: hash, size, runs [(start, end)] of bytes that go; runs are different, and may overlap."""
    found = docs.where(F.col("size") >= length).select("hash", "raw").mapInArrow(_find(length), ROW)
    paired = stage(found.repartition("anchor").sortWithinPartitions("anchor", "region").mapInArrow(_pair, ROW))
    regions = paired.where("not covered").select("anchor", "hash", "size", "start", "end", "twin")
    hot = regions.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > task)
    salt = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("hash", "start"), F.ceil(F.col("n") / task))).otherwise(-1).cast("int")
    wanted = regions.join(hot, "anchor", "left").groupBy("hash", "size").agg(F.collect_list(F.struct("anchor", salt.alias("salt"), "start", "end", "twin")).alias("wanted"))
    # Bytes of the wanted regions, from one copy of each text. A row lists regions of its own text only.
    one = docs.groupBy("hash", "size").agg(F.min("doc_id").alias("one"))
    wanted = wanted.join(one, ["hash", "size"])
    sliced = docs.join(wanted, ["hash", "size"]).where(F.col("doc_id").eqNullSafe(F.col("one"))).select("hash", "size", "wanted", "raw")
    sliced = sliced.mapInArrow(_slices, "anchor long, salt int, hash long, size int, start int, twin boolean, raw binary")
    searched = stage(sliced.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_search(length), RUN))
    crossing = searched.where("signature is not null")
    known = crossing.groupBy("signature").agg((F.max("several") | (F.min(F.struct("hash", "start")) != F.max(F.struct("hash", "start")))).alias("again")).where("again")
    late = crossing.where("not several").join(known, "signature").select("hash", "size", "start", "end")
    every = paired.where("covered").select("hash", "size", "start", "end").union(searched.where("signature is null").select("hash", "size", "start", "end")).union(late)
    # Each copy of a text puts out its runs; they are the same, and go to the text once.
    return every.distinct().groupBy("hash", "size").agg(F.collect_list(F.struct("start", "end")).alias("runs"))


def _cut(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int]:
    """What is left of ``raw``, and the number of maximal runs that went."""
    starts, ends = merged(starts, ends)
    edges = [0, *(x for pair in zip(starts.tolist(), ends.tolist()) for x in pair), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])), len(starts)


def remove_repeats(docs: DataFrame, length: int = LENGTH, task: int = TASK, digest: bool = False) -> DataFrame:
    """``docs`` (doc_id, text and more) with kept, n_bytes, n_removed, n_spans and kept_sha256.

    ``kept`` is the text without its repeats; where a cut went through a character, the
    rest of that character is left out. kept_sha256 is of the bytes before that.
    With ``digest``, only doc_id and the last four are returned. A null text
    counts as empty and stays null. All rows of a text lose the same bytes, repeated
    rows included: copies are repeats of each other. Columns of these names are replaced.
    """
    added = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*added).select("doc_id", "text") if digest else docs.drop(*added)
    hash_, size, runs = (free_name(docs, c) for c in ("hash", "size", "runs"))
    text = F.col("text")
    keyed = docs.withColumns({hash_: F.xxhash64("text"), size: F.coalesce(F.octet_length(text), F.lit(0))})
    texts = keyed.select("doc_id", F.col(hash_).alias("hash"), F.col(size).alias("size"), text.cast("binary").alias("raw"))
    going = repeats(texts, length, task).select(F.col("hash").alias(hash_), F.col("size").alias(size), F.col("runs").alias(runs))
    shape = docs.select("doc_id") if digest else docs
    names = shape.columns
    out = shape.withColumns(({} if digest else {"kept": F.lit(None).cast("string")}) | {c: F.lit(0).cast("long") for c in added[1:4]} | {"kept_sha256": F.lit("")}).schema

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, total, gone, spans, sha = [], [], [], [], []
            offsets, cuts = _lists(b.column(runs))
            for value, i, j in zip(b.column("text").cast(pa.binary()), offsets[:-1].tolist(), offsets[1:].tolist()):
                value = value.as_py()
                left, n = _cut(value, cuts["start"][i:j], cuts["end"][i:j]) if j > i else (value or b"", 0)
                if not digest:
                    kept.append(None if value is None else left.decode("utf-8", "ignore"))
                total.append(len(value or b""))
                gone.append(len(value or b"") - len(left))
                spans.append(n)
                sha.append(hashlib.sha256(left).hexdigest())
            columns = ([] if digest else [pa.array(kept, pa.string())]) + [pa.array(x, pa.int64()) for x in (total, gone, spans)] + [pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + columns, names=out.names)

    read = names if "text" in names else [*names, "text"]
    return keyed.join(going, [hash_, size], "left").select(*read, runs).mapInArrow(run, out)
