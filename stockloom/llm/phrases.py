"""Phrase collocations by direct-address tiles over frequency-ranked ids.

Texts are cut into words on arrays, and each language's words into blocks of local ids. Words that
are frequent enough get ids by frequency. Neighbouring ids of a sequence make pairs; the pairs
of the ``ZONE`` most frequent ids fall into square tiles of ``TILE`` x ``TILE`` cells, which blocks count by bincount (or
as sorted coordinates where a block has few) and which are summed in one dense table each, tile
after tile. Pairs outside that zone are sparse: sorted coordinates, dealt to buckets by a hash and summed there.
Frequent pairs are ranked again and take the place of the ids, so neighbours in the new sequence
are phrases of one word more; and so on up to the longest phrase.

Any part of a frequent phrase is frequent, so nothing is lost, and all counts that scores need are
at hand. A word or phrase enters a shuffle once for each block that has it, however
often it occurs. A bitmap of fixed size tells blocks which of their pairs may be frequent; the join that
follows is exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import LOWER, UPPER, stage
from stockloom.llm.words import flat
from stockloom.operators.ordering import global_rank

TILE, TILES = 1 << 10, 16
ZONE = TILE * TILES
#: Bytes of one language's text in a block, and of all languages' texts that wait for one.
BLOCK, WAITING = 4 << 20, 16 << 20
#: Words or pairs that every task knows, and the most bytes of a word among them.
HOT, HOT_BYTES = 1 << 18, 64
#: Blocks whose cells one task sums into a tile.
TOGETHER = 1024
#: Bits of the bitmap, for each pair and at most.
BITS_EACH, MOST_BITS = 32, 1 << 26
#: Characters that part pieces, and words.
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"

KIND = np.zeros(256, np.uint8)
KIND[list(GAPS)], KIND[list(BREAKS)] = 1, 2
FOLD = np.arange(256, dtype=np.uint8)
FOLD[list(UPPER.encode())] = list(LOWER.encode())


# -- sequences ----------------------------------------------------------------

def pack_ids(ids: np.ndarray) -> bytes:
    """Ids (-1: none) as byte planes, as many as the largest needs; the first byte is their number."""
    up = ids.astype(np.int64) + 1
    k = max(1, (int(up.max(initial=0)).bit_length() + 7) // 8)
    return bytes([k]) + up.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    k = value[0]
    out = np.zeros(((len(value) - 1) // k, 8), np.uint8)
    out[:, :k] = np.frombuffer(value, np.uint8, offset=1).reshape(k, -1).T
    return out.view("<i8").ravel() - 1


def squeezed(ids: np.ndarray) -> np.ndarray:
    """Without all but one of several -1 in a row."""
    gone = ids < 0
    return ids[~(gone & np.append(False, gone[:-1]))]


def neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs, and their first and second ids."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return at, ids[at], ids[at + 1]


def codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair, equal only for equal pairs."""
    if not len(a):
        return np.empty(0, np.int64)
    if (int(a.max()) + 1) * (int(b.max()) + 1) < 1 << 62:
        return a * (int(b.max()) + 1) + b
    b_values, b_at = np.unique(b, return_inverse=True)
    return np.unique(a, return_inverse=True)[1] * len(b_values) + b_at


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Local ids of the words of all texts (-1 between pieces), the different words, and how often each occurs."""
    data, at, _ = flat(texts)
    kind = KIND[data]
    word, edge = kind == 0, np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.append(True, ~word[:-1])[:len(word)], np.append(~word[1:], True)[:len(word)]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    if not len(starts):
        return np.empty(0, np.int64), pa.array([], pa.large_string()), np.empty(0, np.int64)
    piece = np.searchsorted(np.flatnonzero((kind == 2) | edge[:-1]), starts, "right")
    letters = FOLD[data[word]]
    bounds = np.append(0, np.cumsum(ends - starts))
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters)).dictionary_encode()
    k = found.indices.to_numpy().astype(np.int64)
    broke = np.append(0, np.cumsum(np.diff(piece) != 0))
    out = np.full(len(k) + int(broke[-1]), -1)
    out[np.arange(len(k)) + broke] = k
    return out, found.dictionary, np.bincount(k, minlength=len(found.dictionary))


STAGED = "block long, lang string, seq binary, slots binary, ids binary, slot int, word string, a long, b long, n long"


def _batch(block: int, lang: str, seq: np.ndarray, slot: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None, **rows: pa.Array) -> Iterator[pa.RecordBatch]:
    """A block's sequence, with the slots whose ids are ``known``, then its dictionary."""
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("seq", pa.binary()), ("slots", pa.binary()), ("ids", pa.binary()), ("slot", pa.int32()),
                        ("word", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    one = {"block": pa.array([block], pa.int64()), "lang": pa.array([lang]), "seq": pa.array([pack_ids(seq)], pa.binary())}
    if known is not None:
        one |= {name: pa.array([pack_ids(x)], pa.binary()) for name, x in zip(("slots", "ids"), known)}
    yield pa.RecordBatch.from_arrays([one.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)
    size = len(slot)
    if size:
        many = rows | {"block": pa.array(np.full(size, block)), "lang": pa.DictionaryArray.from_arrays(pa.array(np.zeros(size, np.int32)), pa.array([lang])).cast(pa.string()), "slot": pa.array(slot)}
        yield pa.RecordBatch.from_arrays([many[f.name].cast(f.type) if f.name in many else pa.nulls(size, f.type) for f in schema], schema=schema)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}
    block = TaskContext.get().partitionId() << 32

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal block
        size.pop(lang)
        seq, words, n = cut(pa.concat_arrays([x.cast(pa.large_string()) for x in waiting.pop(lang)]))
        if len(seq):
            yield from _batch(block, lang, seq, np.arange(len(words)), word=words, n=pa.array(n))
            block += 1
        pa.default_memory_pool().release_unused()  # the worker lives on

    for b in batches:
        langs = b.column("lang").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = b.column("text").filter(pc.equal(langs.indices, k))
            waiting.setdefault(lang, []).append(texts)
            size[lang] = size.get(lang, 0) + texts.nbytes
        while size and (size[most := max(size, key=size.get)] >= BLOCK or sum(size.values()) >= WAITING):
            yield from flush(most)
    for lang in list(size):
        yield from flush(lang)


def _relabelled(staged: DataFrame, slots: DataFrame) -> DataFrame:
    """Sequences (block, lang, seq) with the ids of ``slots`` (home, slot, id, or packed slots and ids); others become -1."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        seq = [unpack_ids(x.as_py()) for x in left.column("seq")]
        if not seq:
            return left.select(["block", "lang", "seq"])
        ids = np.full(int(seq[0].max(initial=0)) + 2, -1)  # the last is that of -1
        if left.column("slots")[0].is_valid:
            ids[unpack_ids(left.column("slots")[0].as_py())] = unpack_ids(left.column("ids")[0].as_py())
        for slot, one, packed, many in zip(*(right.column(c).to_pylist() for c in ("slot", "id", "slots", "ids"))):
            if packed is None:
                ids[slot] = one
            else:
                ids[unpack_ids(packed)] = unpack_ids(many)
        return left.select(["block", "lang"]).append_column("seq", pa.array([pack_ids(squeezed(ids[seq[0]]))], pa.binary()))

    seqs = staged.where("seq is not null").select("block", "lang", "seq", "slots", "ids")
    return stage(seqs.groupBy("block").cogroup(slots.groupBy("home")).applyInArrow(run, "block long, lang string, seq binary"))


SLOTS = "home long, slot int, id long, slots binary, ids binary"


def _word_index(table: pa.Table) -> pa.Table:
    return table.select(["word", "id"]).combine_chunks()


def _find_words(index: pa.Table, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Which rows' words the index has, and the ids of those."""
    place = pc.index_in(rows.column("word"), index.column("word").combine_chunks())
    return place.is_valid().to_numpy(zero_copy_only=False), index.column("id").to_numpy()[place.drop_null().to_numpy()]


def _pair_index(table: pa.Table) -> tuple[np.ndarray, ...]:
    a, b, ids = (table.column(c).to_numpy() for c in ("a", "b", "id"))
    firsts, seconds = np.unique(a), np.unique(b)
    code = np.searchsorted(firsts, a) * len(seconds) + np.searchsorted(seconds, b)
    order = np.argsort(code)
    return firsts, seconds, code[order], ids[order]


def _find_pairs(index: tuple[np.ndarray, ...] | None, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs the index has, and the ids of those."""
    if index is None or not len(a):
        return np.zeros(len(a), bool), np.empty(0, np.int64)
    firsts, seconds, code, ids = index
    at = [np.minimum(np.searchsorted(x, v), len(x) - 1) for x, v in ((firsts, a), (seconds, b))]
    here = at[0] * len(seconds) + at[1]
    place = np.minimum(np.searchsorted(code, here), len(code) - 1)
    hit = (firsts[at[0]] == a) & (seconds[at[1]] == b) & (code[place] == here)
    return hit, ids[place[hit]]


def _hot(ranked: DataFrame, keys: list[str]) -> tuple[Broadcast, DataFrame]:
    """An index by language of the ``HOT`` most frequent words or pairs (``keys``), which most blocks have, and the rows of all others.

    Words of the index have at most ``HOT_BYTES``, so its size is bounded.
    """
    short = ranked.where(F.octet_length("word") <= HOT_BYTES) if keys == ["word"] else ranked
    top = stage(short.orderBy(F.desc("n"), "lang", *keys).limit(HOT).select("lang", *keys, "id"))
    table, index = top.toArrow(), _word_index if keys == ["word"] else _pair_index
    known = {x: index(table.filter(pc.equal(table.column("lang"), x))) for x in table.column("lang").unique().to_pylist()}
    rest = ranked.join(F.broadcast(top.select("lang", *keys)), ["lang", *keys], "left_anti").select("lang", *keys, "id")
    return ranked.sparkSession.sparkContext.broadcast(known), stage(rest)


def _by_join(rows: DataFrame, rest: DataFrame, keys: list[str]) -> DataFrame:
    """Ids of the blocks' words or pairs that the index does not have."""
    none = F.lit(None).cast("binary")
    return rows.join(rest, ["lang", *keys]).select(F.col("block").alias("home"), "slot", "id", none.alias("slots"), none.alias("ids"))


def _word_slots(rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """Ids of the blocks' words, those of the index packed in a few rows for each block."""
    known, rest = _hot(ranked, ["word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = b.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            out = []
            for low, high in zip(edges, edges[1:]):
                if high > low and (hot := known.value.get(b.column("lang")[low].as_py())) is not None:
                    here = b.slice(low, high - low)
                    hit, ids = _find_words(hot, here)
                    out.append((int(block[low]), pack_ids(here.column("slot").to_numpy()[hit]), pack_ids(ids)))
            if out:
                home, slots, ids = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int64()), pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.int64()), pa.array(slots, pa.binary()), pa.array(ids, pa.binary())],
                                                 names=["home", "slot", "id", "slots", "ids"])

    found = rows.select("block", "lang", "slot", "word").mapInArrow(run, SLOTS)
    return found.union(_by_join(rows, rest, ["word"])) if rest.limit(1).count() else found


# -- counting -----------------------------------------------------------------

PAIRS = "lang string, a long, b long, n long"
CELLS = "lang string, tile int, block long, first binary, second binary, counts binary"


def _pairs_batch(lang: str, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), *(pa.array(x, pa.int64()) for x in (a, b, n))], names=["lang", "a", "b", "n"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.column("block")[i].as_py(), b.column("lang")[i].as_py(), unpack_ids(b.column("seq")[i].as_py())


def dense_cells(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, bytes, None, bytes]]:
    """For each tile that has pairs: steps from cell to cell, and counts."""
    tile = ((a // TILE) * TILES + b // TILE).astype(np.int16)
    order = np.argsort(tile, kind="stable")
    cell = ((a % TILE) * TILE + b % TILE)[order]
    sizes = np.bincount(tile, minlength=TILES * TILES)
    ends = np.cumsum(sizes)
    for t in np.flatnonzero(sizes):
        here = cell[ends[t] - sizes[t]:ends[t]]
        if sizes[t] >= TILE * TILE // 32:
            table = np.bincount(here, minlength=TILE * TILE)
            at = np.flatnonzero(table)
            n = table[at]
        else:
            at, n = np.unique(here, return_counts=True)
        yield int(t), pack_ids(np.diff(at, prepend=0)), None, pack_ids(n)


def sparse_cells(a: np.ndarray, b: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """For each bucket that has pairs: sorted coordinates, and counts."""
    _, at, n = np.unique(codes(a, b), return_index=True, return_counts=True)
    a, b = a[at], b[at]
    with np.errstate(over="ignore"):
        mixed = (a * np.int64(0x1E3779B97F4A7C15) + b) * np.int64(0x3F58476D1CE4E5B9)
    bucket = (mixed >> 32) % buckets
    order = np.argsort(bucket, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        yield TILES * TILES + int(bucket[rows[0]]), pack_ids(a[rows]), pack_ids(b[rows]), pack_ids(n[rows])


def _cells(buckets: int):
    """What each block has of each tile and bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, lang, seq in _sequences(batches):
            _, a, b = neighbours(seq)
            near = (a < ZONE) & (b < ZONE)
            rows = [(lang, t, block, *cells) for part in (dense_cells(a[near], b[near]), sparse_cells(a[~near], b[~near], buckets)) for t, *cells in part]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["lang", "tile", "block", "first", "second", "counts"])

    return run


def _summed(least_dense: int, least: int):
    """Sum one tile after the other in a dense table, and one bucket after the other by sorting."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, waiting = None, np.zeros(TILE * TILE, np.int64), []

        def flush() -> pa.RecordBatch:
            lang, tile, _ = now
            if tile < TILES * TILES:
                at = np.flatnonzero(table >= least_dense)
                out = _pairs_batch(lang, tile // TILES * TILE + at // TILE, tile % TILES * TILE + at % TILE, table[at])
                table[:] = 0
                return out
            a, b, n = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            code = codes(a, b)
            order = np.argsort(code)
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            total = np.add.reduceat(n[order], first)
            at = order[first[total >= least]]
            return _pairs_batch(lang, a[at], b[at], total[total >= least])

        for rows in batches:
            for lang, tile, part, first, second, counts in zip(*(rows.column(c).to_pylist() for c in ("lang", "tile", "part", "first", "second", "counts"))):
                if (lang, tile, part) != now:
                    if now:
                        yield flush()
                    now = (lang, tile, part)
                if second is None:
                    table[np.cumsum(unpack_ids(first))] += unpack_ids(counts)
                else:
                    waiting.append((unpack_ids(first), unpack_ids(second), unpack_ids(counts)))
        if now:
            yield flush()

    return run


def pair_counts(seqs: DataFrame, least: int) -> DataFrame:
    """Pairs of neighbouring ids (lang, a, b, n) that occur at least ``least`` times. ``seqs`` is staged.

    A tile that more than ``TOGETHER`` blocks may have is summed in parts, whose sums are added by
    Spark; the number of buckets grows with that of blocks, so a bucket is as large as a few blocks.
    """
    blocks = seqs.count()
    parts, buckets = max(1, -(-blocks // TOGETHER)), max(1, -(-blocks // 4))
    cells = seqs.mapInArrow(_cells(buckets), CELLS)
    part = F.when(F.col("second").isNull(), F.pmod(F.xxhash64("block"), F.lit(parts))).otherwise(0).cast("int")
    cells = cells.select("lang", "tile", part.alias("part"), "first", "second", "counts")
    cells = cells.repartition("lang", "tile", "part").sortWithinPartitions("lang", "tile", "part")
    found = cells.mapInArrow(_summed(least if parts == 1 else 1, least), PAIRS)
    return found.groupBy("lang", "a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least) if parts > 1 else found


# -- the next level -----------------------------------------------------------

def _bits(lang: str, a: np.ndarray, b: np.ndarray, n_bits: int) -> np.ndarray:
    """Places of pairs in the bitmap."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(zlib.crc32(lang.encode()))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n_bits)).astype(np.int64)


def bitmap(pairs: DataFrame, n_bits: int) -> np.ndarray:
    """Set bits of all pairs (lang, a, b), as bytes; at most ``MOST_BITS`` / 64 rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            langs = p.column("lang").dictionary_encode()
            a, b, k = p.column("a").to_numpy(), p.column("b").to_numpy(), langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                at = np.unique(_bits(lang, a[k == i], b[k == i], n_bits))
                place, first = np.unique(at // 32, return_index=True)
                word = np.bitwise_or.reduceat(np.int64(1) << (at % 32), first) if len(at) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(word, pa.int64())], names=["place", "word"])

    rows = pairs.select("lang", "a", "b").mapInArrow(run, "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(n_bits // 32, "<u4")
    words[rows.column("place").to_numpy()] = rows.column("word").to_numpy()
    return np.unpackbits(words.view(np.uint8), bitorder="little").view(bool)


def _joined(seqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sequences whose ids are those of ``pairs`` (lang, a, b, n, id) that start at each place.

    Blocks know the ids of the most frequent pairs; of the others, they name those that the bitmap has.
    """
    hot, rest = _hot(pairs, ["a", "b"])
    n_bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * rest.count()).bit_length()))
    known = seqs.sparkSession.sparkContext.broadcast(np.packbits(bitmap(rest, n_bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(known.value).view(bool)
        for block, lang, seq in _sequences(batches):
            at, a, b = neighbours(seq)
            _, first, local = np.unique(codes(a, b), return_index=True, return_inverse=True)
            a, b = a[first], b[first]
            hit, ids = _find_pairs(hot.value.get(lang), a, b)
            asked = may[_bits(lang, a, b, n_bits)] & ~hit
            keep = hit | asked
            slot = np.cumsum(keep) - 1
            new = np.full(len(seq), -1)
            new[at] = np.where(keep, slot, -1)[local]
            if keep.any():
                yield from _batch(block, lang, squeezed(new), slot[asked], (slot[hit], ids), a=pa.array(a[asked]), b=pa.array(b[asked]))

    staged = stage(seqs.mapInArrow(run, STAGED))
    return _relabelled(staged, _by_join(staged.where("slot is not null"), rest, ["a", "b"]))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """With id: place by falling frequency among those of a language, from 0."""
    out = global_rank(rows, [-F.col("n"), *map(F.col, keys)], "id", ["lang"])
    return stage(out.withColumn("id", F.col("id") - 1))


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """Each language's best collocations.

    ``docs`` has text and lang; other columns are not looked at. A-Z is lower-cased, pieces end at
    ``BREAKS``, words are what ``GAPS`` part. A null text is empty, a null lang is ``und``; repeated rows count as often
    as they are there. Phrases of 2 to ``longest`` words that occur ``least`` times are scored by their worst cut (ties: the first)
    and dropped if a longer one occurs as often. Returns lang, rank, phrase, a, l, r, n, score; ties in
    score are in order of falling a, then the phrase's bytes. No rows give no rows.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    staged = stage(texts.mapInArrow(_words, STAGED))
    words = staged.where("slot is not null").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stage(words)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    ranked = _ranked(words.where(F.col("n") >= least), ["word"])
    seqs = _relabelled(staged, _word_slots(staged.where("slot is not null"), ranked))
    none = F.array().cast("array<bigint>")
    level = ranked.select("lang", "id", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", none.alias("first_n"), none.alias("last_n"))
    levels = []
    for size in range(2, longest + 1):
        pairs = _ranked(pair_counts(seqs, least), ["a", "b"])
        first = level.select("lang", F.col("id").alias("a"), F.col("phrase").alias("head"), F.col("n").alias("n_a"), "first_n")
        second = level.select("lang", F.col("id").alias("b"), "last", F.col("n").alias("n_b"), "last_n")
        level = pairs.join(first, ["lang", "a"]).join(second, ["lang", "b"]).select(
            "lang", "id", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "n", "a", "b", "n_a", "n_b",
            F.concat("first_n", F.array("n_a")).alias("first_n"), F.concat("last_n", F.array("n_b")).alias("last_n"))
        level = stage(level)
        levels.append(level)
        if size < longest:
            seqs = _joined(seqs, pairs)
    found = None
    for size, here in enumerate(levels, 2):
        if size < longest:  # what a phrase of one more word holds as often; longer ones hold that one
            more = levels[size - 1]
            inside = more.where("n = n_a").select("lang", F.col("a").alias("id")).union(more.where("n = n_b").select("lang", F.col("b").alias("id")))
            here = here.join(inside.distinct(), ["lang", "id"], "left_anti")
        here = here.select("lang", "phrase", "n", "first_n", "last_n")
        found = here if found is None else found.union(here)
    scored = found.join(totals, "lang").withColumns({"a": F.col("n"), "parts": F.size("first_n")})
    whole = "cast({} as decimal(38,0))"
    cuts = F.expr(f"""array_min(transform(sequence(1, parts), k -> struct(
        ({whole.format('1000')} * a * total) div ({whole.format('first_n[k - 1]')} * last_n[parts - k]) as score, k, first_n[k - 1] as l, last_n[parts - k] as r)))""")
    scored = scored.withColumn("cut", cuts).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").cast("long").alias("score"))
    ordered = global_rank(scored, [-F.col("score"), -F.col("a"), F.col("phrase")], "rank", ["lang"])
    return ordered.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    """The same in DuckDB, by lists of words."""
    return rf"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
    words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
    grams AS (SELECT lang, k, w[i:i + k - 1] AS g FROM words, unnest(range(1, {longest + 1})) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i)),
    counts AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL),
    totals AS (SELECT lang, sum(a)::HUGEINT AS n FROM counts WHERE k = 1 GROUP BY lang),
    often AS (SELECT * FROM counts WHERE k > 1 AND a >= {least}),
    inner_parts AS (SELECT lang, g[i:i + j - 1] AS g, max(a) AS most FROM often, unnest(range(2, k)) AS s(j), unnest(range(1, k - j + 2)) AS t(i) GROUP BY ALL),
    kept AS (SELECT o.* FROM often o LEFT JOIN inner_parts x ON x.lang = o.lang AND x.g = o.g WHERE x.most IS NULL OR 100 * x.most < 100 * o.a),
    cuts AS (SELECT o.lang, o.g, o.a, j, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * o.a * t.n) // (l.a::HUGEINT * r.a) AS score
             FROM kept o, unnest(range(1, o.k)) AS s(j) JOIN counts l ON l.lang = o.lang AND l.g = o.g[1:j] JOIN counts r ON r.lang = o.lang AND r.g = o.g[j + 1:] JOIN totals t ON t.lang = o.lang),
    worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
    FROM worst QUALIFY rank <= {top}"""
