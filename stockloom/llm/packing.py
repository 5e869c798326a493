"""Packing of documents into sequences by a configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. There,
a configuration is a multiset of lengths that fits into a sequence, and the program asks for the
fewest sequences whose configurations hold all pieces. Multiplicative weights solve it: each length
has a weight that falls as it is covered; each round a knapsack over the capacity prices the best
configuration. Whole parts of the solution are taken, and what is left is filled by the better of two
ways: the largest length and what fills its sequence best, or best fit. Pieces then find their places from
their number among all of their length; no piece passes through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import stage
from stockloom.llm.words import encoder

#: Bits of a key that hold a piece's number; the length is above them.
RANK_BITS = 50
Plan = list[tuple[list[tuple[int, int]], int]]


# -- the plan: lengths only ---------------------------------------------------

def best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each size in the most valuable configuration (knapsack by capacity)."""
    useful = np.flatnonzero(value > np.maximum.accumulate(np.append(0.0, value))[:-1])  # worth more than all smaller ones
    s, v = sizes[useful], value[useful]
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            total = best[c - s[:k]] + v[:k]
            j = int(total.argmax())
            if total[j] > best[c]:
                best[c], pick[c] = total[j], j
    copies, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            copies[useful[pick[c]]] += 1
            c -= s[pick[c]]
    return copies


def fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, step: float) -> dict[tuple[int, ...], float]:
    """Configurations (copies by size) with how often each is taken, so that no size is covered more than once or so."""
    covered, taken = np.zeros(len(sizes)), {}
    for _ in range(rounds):
        if (covered >= 1).all():
            break
        value = np.where(covered < 1, np.exp(-covered / step), 0.0) * sizes / np.minimum(demand * sizes, demand.max() * capacity)
        copies = np.minimum(best_configuration(sizes, value, capacity), demand)
        used = copies > 0
        times = float((demand[used] / copies[used]).min()) * step
        covered[used] += times * copies[used] / demand[used]
        key = tuple(copies.tolist())
        taken[key] = taken.get(key, 0.0) + times
    return taken


def fullest(sizes: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """Copies of each size, at most those left, that fill most of ``room``; among such, the largest sizes first."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for i in range(len(sizes) - 1, -1, -1):
        n, part = int(min(left[i], room // sizes[i])), 1
        while n > 0:  # 1, 2, 4 ... copies at a time
            k = min(part, n)
            steps.append((reach, i, k))
            reach |= reach << int(k * sizes[i]) & mask
            n, part = n - k, 2 * part
        if reach >> room & 1:
            break
    at, copies = reach.bit_length() - 1, np.zeros(len(sizes), np.int64)
    for before, i, k in reversed(steps):
        if not before >> at & 1:
            copies[i] += k
            at -= int(k * sizes[i])
    return copies


def by_fullest(sizes: np.ndarray, left: np.ndarray, capacity: int) -> Plan:
    """Configurations that hold ``left``: the largest size there is, and what fills the rest best."""
    left, out = left.copy(), []
    while left.any():
        i = int(np.flatnonzero(left)[-1])
        copies = np.zeros(len(sizes), np.int64)
        copies[i] = 1
        copies += fullest(sizes, left - copies, capacity - int(sizes[i]))
        used = copies > 0
        times = int((left[used] // copies[used]).min())
        left -= copies * times
        out.append((_listed(sizes, copies), times))
    return out


def by_best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> Plan:
    """Configurations that hold ``left``: sizes falling, each to the least room that takes it; alike sequences at a time."""
    rooms: dict[int, list] = {}
    for i in range(len(sizes) - 1, -1, -1):
        size, n = int(sizes[i]), int(left[i])
        while n:
            room = min((r for r in rooms if r >= size), default=capacity)
            held, there = rooms[room].pop() if room in rooms else ([], n)
            if not rooms.get(room, True):
                del rooms[room]
            copies = min(room // size, n)
            times = min(there, n // copies)
            if held and there > times:
                rooms.setdefault(room, []).append((held, there - times))
            rooms.setdefault(room - copies * size, []).append(([*held, (size, copies)], times))
            n -= copies * times
    return [(held, times) for x in rooms.values() for held, times in x]


def _listed(sizes: np.ndarray, copies: np.ndarray) -> list[tuple[int, int]]:
    return [(int(sizes[i]), int(copies[i])) for i in np.flatnonzero(copies)[::-1]]


def rounded(sizes: np.ndarray, demand: np.ndarray, taken: list[tuple[np.ndarray, float]], waste: int, capacity: int) -> tuple[Plan, np.ndarray]:
    """Whole parts of those configurations that leave at most ``waste`` free, and what they do not hold."""
    left, out = demand.copy(), []
    for copies, times in taken:
        used = copies > 0
        if capacity - copies @ sizes <= waste and (n := min(int(times), int((left[used] // copies[used]).min()))):
            left -= copies * n
            out.append((_listed(sizes, copies), n))
    return out, left


def plan(counts: dict[int, int], capacity: int, rounds: int = 600, step: float = 0.25) -> Plan:
    """Configurations ((size, copies) pairs) and how many sequences take each; together they hold exactly ``counts``.

    The fractional solution is rounded down, once for each of several bounds on what a configuration
    may leave free; what is left is filled by best fit or fullest sequences. The fewest sequences count.
    """
    full: Plan = [([(capacity, 1)], counts[capacity])] if counts.get(capacity) else []
    sizes = np.array(sorted(s for s, n in counts.items() if n and s < capacity), np.int64)
    if not len(sizes):
        return full
    demand = np.array([counts[s] for s in sizes.tolist()], np.int64)
    found = fractional(sizes, demand, capacity, rounds, step)
    taken = [(np.array(key), times) for key, times in sorted(found.items(), key=lambda x: (-x[1], x[0]))]
    size = lambda p: sum(n for _, n in p)
    least, best = -(-int(demand @ sizes) // capacity), None
    for waste in (0, capacity >> 8, capacity >> 5, capacity, -1):
        out, left = rounded(sizes, demand, taken, waste, capacity)
        for way in (by_best_fit, by_fullest) if waste == 0 else (by_best_fit,):
            if best is None or size(best) > least:  # else no plan has fewer
                best = min((x for x in (best, out + way(sizes, left, capacity)) if x is not None), key=size)
    return full + best


def places(rows: Plan) -> dict[str, np.ndarray]:
    """For runs of pieces of a length: key of the first one's number, copies in a sequence, first sequence, first offset; by key."""
    numbered: dict[int, int] = {}
    found, sequence = [], 0
    for configuration, times in rows:
        offset = 0
        for size, copies in configuration:
            first = numbered.get(size, 0)
            found.append(((size << RANK_BITS) + first, copies, sequence, offset))
            numbered[size] = first + copies * times
            offset += size * copies
        sequence += times
    table = np.array(sorted(found), np.int64).reshape(-1, 4)
    return dict(zip(("key", "copies", "sequence", "offset"), table.T))


# -- pieces -------------------------------------------------------------------

def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents, staged: doc_id, piece, start, length, ids_crc32, task and number (of this length in this task)[, ids]."""
    model = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen = encoder(model.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            for low, ids, ends in words.encode(b.column("text")):
                n_docs = len(ends)
                sizes = np.diff(ends, prepend=0) + 1
                with_end = np.insert(ids, ends, end_id).astype("<u4")
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(n_docs), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = sizes - capacity * (n - 1)
                length = np.where(piece == 0, head[doc], capacity)
                start = np.where(piece == 0, 0, head[doc] + capacity * (piece - 1))
                bounds = np.append(0, np.cumsum(length))
                order = np.argsort(length, kind="stable")
                group = length[order]
                inside = np.arange(len(order)) - np.searchsorted(group, group)
                number = np.empty_like(length)
                number[order] = seen[group] + inside
                seen += np.bincount(length, minlength=capacity + 1)
                data = memoryview(with_end).cast("B")
                crc = [zlib.crc32(data[4 * x:4 * y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                columns = [b.column("doc_id").slice(low, n_docs).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                           pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(number, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(with_end.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long" + (", ids array<int>" if keep_ids else "")
    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Sequences of at most ``capacity`` ids that hold all documents.

    ``docs`` has doc_id and text, and any other columns. A document is its ids by
    the byte-level file ``tokenizer_path`` and ``end_id``. Only one longer than
    ``capacity`` is cut; its first piece may be shorter than the others. Returns one row for each
    piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with
    ``keep_ids`` the ids. Sequences are numbered from 0 without gaps, and pieces of a
    sequence lie one after another from offset 0. A null or empty text is its end id;
    a null doc_id and repeated rows are packed like any other. No rows give no sequences.

    Each task numbers the pieces of each length it makes; one row for each length and task adds those
    of tasks before. A length that most pieces have is therefore never in one task.
    """
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer_path, capacity, end_id, keep_ids)
    made = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    # One row for each task that has the length.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    made = stage(made.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    # At most ``capacity`` rows.
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(counts, capacity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = table.value
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            key = (length << RANK_BITS) + rank
            k = np.searchsorted(at["key"], key, "right") - 1
            nth, within = np.divmod(key - at["key"][k], at["copies"][k])
            found = [pa.array(at["sequence"][k] + nth), pa.array(at["offset"][k] + within * length)]
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *found], names=[*keep, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = cut.join(made.drop("n"), ["length", "task"]).select(*kept, (F.col("number") + F.col("before")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
