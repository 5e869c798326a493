"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit of the fingerprint gets a vector m(bit) of radius + 1 bits, not zero.
Table v (any such vector but zero) hashes the bits with odd <m(bit), v>. Two
fingerprints that differ in at most ``radius`` bits give at most ``radius``
equations <m(bit), v> = 0, which some v fulfils: that table masks all bits
in which they differ, so the pair meets there, always.

Equal fingerprints are one node. Inside a bucket, pairs are verified by their
distance, and only a spanning forest of the links is put out. A bucket of many
different fingerprints is hashed again by a covering of the bits in which its
members still differ, which halves those bits each time; so no bucket is
compared all against all, and none is capped. Buckets that would be too large
for one task are hashed a second time before they are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import released, stage
from stockloom.llm.components import components
from stockloom.llm.similar import one_of_each  # noqa: F401

#: Buckets of up to this many fingerprints are compared directly.
DIRECT = 1024
#: Buckets of about this many fingerprints and more are split before they reach a task.
SPLIT = 1_000_000
CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int, longs: int = 1) -> list[int]:
    """Fingerprint of 64 or 128 bits as signed longs: a bit is 1 if set in over half of the shingles' hashes.

    The hash is XXH64 with seed 42 for one long, XXH3's 128 bits for two. Shingles are runs
    of ``shingle`` words joined by spaces; fewer words are one shingle, none give zeros.
    """
    w = (text or b"").lower().split()  # on bytes: A-Z, and white space \x20 and \x09-\x0D only
    if not w:
        return [0] * longs
    total, n = np.zeros(64 * longs, np.int64), max(1, len(w) - shingle + 1)
    join = b" ".join
    for start in range(0, n, CHUNK):
        grams = [join(w[i:i + shingle]) for i in range(start, min(n, start + CHUNK))]
        if longs == 1:
            h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8").view(np.uint8)
        else:
            h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, grams)), np.uint8)
        total += np.unpackbits(h.reshape(-1, 8 * longs), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * total > n, bitorder="little").view("<i8").tolist()


def with_fingerprints(docs: DataFrame, shingle: int, names: Sequence[str] = ("fingerprint",)) -> DataFrame:
    """``docs`` without ``text``, and with its fingerprint in the columns ``names`` (one or two longs); those of these names are replaced.

    The text does not come back from the Python workers, so that batches stay small.
    """
    docs, names, k = docs.drop(*names), list(names), len(names)
    rest = docs.drop("text")
    columns, schema = rest.columns, rest.withColumns({c: F.lit(0).cast("long") for c in names}).schema

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(x.as_py(), shingle, k) for x in b.column("text").cast(pa.binary())], np.int64).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(prints[:, i]) for i in range(k)], names=[*columns, *names])

    return docs.mapInArrow(run, schema)


def masks(bits: list[int], radius: int) -> list[int]:
    """The bits that each table of a covering of ``bits`` keeps."""
    size = 1 << (radius + 1)
    # Unit vectors first, so that no table masks everything.
    code = [1 << k if k <= radius else k * 0x9E3779B1 % (size - 1) + 1 for k in range(len(bits))]
    kept = [sum(1 << bit for bit, m in zip(bits, code) if (m & v).bit_count() % 2) for v in range(1, size)]
    return list(dict.fromkeys(kept))


def _forest(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (root, member) of a boolean matrix of links."""
    n, roots, members = len(close), [], []
    new = np.ones(n, bool)
    while new.any():
        root = int(new.argmax())
        part = np.zeros(n, bool)
        front = np.array([root])
        while len(front):
            part[front] = True
            front = np.flatnonzero(close[front].any(0) & ~part)
        new &= ~part
        part[root] = False
        found = np.flatnonzero(part)
        roots.append(np.full(len(found), root))
        members.append(found)
    return np.concatenate(roots), np.concatenate(members)


@dataclass(frozen=True)
class Slice:
    """Bits ``low`` to ``high`` of a long of the fingerprint."""

    column: int
    low: int
    high: int

    @property
    def bits(self) -> list[int]:
        return list(range(self.low, self.high))


@dataclass(frozen=True)
class Covering:
    """Pairs within ``radius`` bits in all are found: some slice differs by at most radius // slices, and has tables for that.

    Pairs that meet in a table are links up to ``accept`` bits; of those beyond ``radius`` most meet.
    """

    longs: int
    slice_bits: int
    radius: int
    accept: int

    @property
    def slices(self) -> list[Slice]:
        return [Slice(c, low, low + self.slice_bits) for c in range(self.longs) for low in range(0, 64, self.slice_bits)]

    @property
    def per_slice(self) -> int:
        return self.radius // len(self.slices)

    @staticmethod
    def of_similarity(similarity: float, longs: int = 2, slice_bits: int = 32) -> Covering:
        """For texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

        Such pairs have a cosine of 2s / (1 + s), so arccos / pi of the bits differ in the
        mean; accepted is that and one and a half standard deviations.
        """
        p = math.acos(2 * similarity / (1 + similarity)) / math.pi
        n = 64 * longs
        mean = n * p
        slices = longs * (64 // slice_bits)
        return Covering(longs, slice_bits, slices * int(mean / slices + 1) - 1, int(mean + 1.5 * math.sqrt(n * p * (1 - p))))


EXACT = Covering(1, 64, 4, 4)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def links(x: np.ndarray, part: Slice, radius: int, accept: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (row, row) of the links among the different fingerprints ``x`` (rows of uint64).

    A link is at most ``radius`` differing bits in ``part`` and ``accept`` in all. A star's
    rows hang together by links, though not each by one with its centre.
    """
    y = x[:, part.column]
    differ = int(np.bitwise_or.reduce(y ^ y[0]))
    bits = [b for b in part.bits if differ >> b & 1]
    if len(x) <= DIRECT or len(bits) <= max(10, radius + 1):
        close = np.zeros((len(x), len(x)), bool) if len(x) <= 4 * DIRECT else None
        if close is None:
            return _wide(x, accept)
        for i in range(0, len(x), 256):
            close[i:i + 256] = _distance(x[i:i + 256, None], x[None]) <= accept
        return _forest(close)
    out = []
    for mask in masks(bits, radius):
        key = y & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        key = key[order]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j - i > 1:
                a, b = links(x[order[i:j]], part, radius, accept)
                out.append((order[i:j][a], order[i:j][b]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(c) for c in zip(*out)]), axis=1)
    return pairs[0], pairs[1]


def _wide(x: np.ndarray, accept: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars among many rows that are alike in their slice: each round, one row links all it reaches that has no link."""
    free, a, b = np.arange(len(x)), [], []
    queue: list[int] = []
    while len(free):
        if not queue:
            queue, free = [int(free[0])], free[1:]
        i = queue.pop()
        near = _distance(x[free], x[i]) <= accept
        a.append(np.full(int(near.sum()), i))
        b.append(free[near])
        queue += free[near].tolist()
        free = free[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _of_buckets(cover: Covering):
    slices, names = cover.slices, [f"f{i}" for i in range(cover.longs)]

    def found(bucket: np.ndarray, part: np.ndarray, node: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, bucket[1:] != bucket[:-1]]
        cuts = np.flatnonzero(np.r_[new, True])
        sizes = np.diff(cuts)
        size = np.repeat(sizes, sizes)
        a, b = [], []
        for shift in range(1, 8):  # pairs of small buckets, all buckets at once
            i = np.flatnonzero((size[shift:] <= 8) & (bucket[shift:] == bucket[:-shift]))
            i = i[_distance(x[i], x[i + shift]) <= cover.accept]
            a.append(node[i])
            b.append(node[i + shift])
        for i in np.flatnonzero(sizes > 8):
            own = slice(cuts[i], cuts[i + 1])
            p, q = links(x[own], slices[part[cuts[i]]], cover.per_slice, cover.accept)
            a.append(node[own][p])
            b.append(node[own][q])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []  # the bucket that may go on in the next batch
        for batch in batches:
            bucket, part, node = (batch.column(c).to_numpy() for c in ("bucket", "part", "node"))
            x = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names], axis=1)
            if not len(x):
                continue
            if bucket[0] != bucket[-1] or kept and kept[0][0][0] != bucket[-1]:
                last = int(np.searchsorted(bucket, bucket[-1]))
                kept.append((bucket[:last], part[:last], node[:last], x[:last]))
                yield found(*[np.concatenate(c) for c in zip(*kept)])
                kept, bucket, part, node, x = [], bucket[last:], part[last:], node[last:], x[last:]
            kept.append((bucket, part, node, x))
        if kept:
            yield found(*[np.concatenate(c) for c in zip(*kept)])

    return run


def _signed(mask: int):
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def near_links(nodes: DataFrame, cover: Covering, split: int = SPLIT) -> DataFrame:
    """Links (a, b) of ``node`` that connect all pairs of ``nodes`` (node, f0, f1, ...; each once) that ``cover`` finds."""
    names = [f"f{i}" for i in range(cover.longs)]
    tables = [(p, s, m) for p, s in enumerate(cover.slices) for m in masks(s.bits, cover.per_slice)]
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.lit(p).alias("part"), F.col(names[s.column]).bitwiseAND(_signed(m)).alias("kept")) for t, (p, s, m) in enumerate(tables)]))
    rows = nodes.select("node", *names, keys.alias("k")).select("node", *names, "k.part", "k.table", F.xxhash64("k.table", "k.kept").alias("bucket"))
    # One node in 64 tells which buckets are very large; the choice changes the work, not the links.
    large = stage(rows.where(F.pmod(F.xxhash64("node"), F.lit(64)) == 0).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= split / 64).select("bucket"))
    if not large.isEmpty():
        again = None
        for t, (_, s, m) in enumerate(tables):
            rest = masks([b for b in s.bits if not m >> b & 1], cover.per_slice)
            finer = F.array(*[F.xxhash64("bucket", F.lit(u), F.col(names[s.column]).bitwiseAND(_signed(k))) for u, k in enumerate(rest)])
            again = F.when(F.col("table") == t, finer) if again is None else again.when(F.col("table") == t, finer)
        fine = rows.join(large, "bucket", "left_semi").select("node", *names, "part", F.explode(again).alias("bucket"))
        rows = rows.join(large, "bucket", "left_anti").select("node", *names, "part", "bucket").union(fine)
    rows = rows.select("bucket", "part", "node", *names).repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_of_buckets(cover), "a long, b long").distinct()


def classes(prints: DataFrame, names: Sequence[str] = ("fingerprint",), cover: Covering = EXACT, split: int = SPLIT) -> DataFrame:
    """``prints`` (doc_id, ``names`` and more) with component_id: the least doc_id reachable over links, its own included.

    Null doc_ids are no least ones, unless a component has no other. Repeated
    rows each keep their row. No rows give no rows. A fingerprint of one long is
    its own node; longer ones are known by a 64-bit hash.
    """
    prints = prints.drop("component_id")
    node = F.col(names[0]) if len(names) == 1 else F.xxhash64(*names)
    nodes = stage(prints.groupBy(*names).agg(F.min("doc_id").alias("least")).select(node.alias("node"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(names)], "least"))
    roots = components(near_links(nodes.drop("least"), cover, split))
    nodes = stage(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    own = nodes.join(ids, "root").select(*[F.col(f"f{i}").alias(c) for i, c in enumerate(names)], "component_id")
    return prints.join(own, list(names))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (64 bits), component_id; links are up to ``radius`` differing bits."""
    prints = stage(with_fingerprints(docs.select("doc_id", "text"), shingle))
    return classes(prints, cover=Covering(1, 64, radius, radius))
