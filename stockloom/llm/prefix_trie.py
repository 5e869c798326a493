"""Prefix trie of conversations by ROLLUP over positional turn columns.

A turn is known by two 64-bit hashes of role and text, and the first d turns of a conversation
by the sums of position-marked hashes of its turns (four sums of 32-bit halves), so nodes are
found and compared without any text. Conversations are cut into blocks of ``WIDTH`` turns, one column
for each place. GROUP BY block, node before the block, ROLLUP (t1 .. t8) gives all prefixes of all
blocks together; its grouping_id tells the depth. A second ROLLUP over the nodes sums
what lies below each in its block. Totals of whole blocks are added to the nodes they hang
from by doubling pointers, in as many rounds as the number of blocks of the longest conversation has bits.

Positions and sums come from range-partitioned running totals, so a conversation, first turn or
prefix that holds a third of all rows is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import split_words, stage
from stockloom.operators.ordering import running_totals

WIDTH = 8
SUMS = ["s1", "s2", "s3", "s4"]
KEY = ["k1", "k2", "k3", "k4"]
TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]
SPACE = r"[\x20\x09-\x0D]+"


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), a and b (hashes of role and text), words.

    Turns are in order of turn (null first), then role, then text; a null role or text is
    empty, repeated rows all count. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    ranked = running_totals(rows, [F.col("turn"), F.col("role"), F.col("text")], {"pos": F.lit(1).cast("long")}, ["conv_id"])
    return ranked.select("conv_id", "pos", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"),
                         F.size(split_words(F.col("text"), SPACE)).cast("long").alias("words"))


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Give conversations the first turns of another: h = crc32(decimal conv_id) % ``heads`` of conv_id - conv_id % ``family``, then their own after the first h.

    One with fewer turns gives all it has, an absent one none. ``turns`` is ``numbered``; adds
    total (turns of the rebuilt conversation). One that has no turn left has one row with pos 0.
    """
    size = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    size = stage(size.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")))
    given = size.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    size = size.join(given, "base", "left").withColumn("got", F.least("h", F.coalesce("there", F.lit(0))))
    size = stage(size.withColumn("total", F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).drop("there", "own"))
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    head = size.where("got > 0").join(first, "base").where("pos <= got").select("conv_id", "total", "pos", "a", "b", "words")
    own = turns.join(size, "conv_id").where("pos > h").select("conv_id", "total", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "a", "b", "words")
    nothing = F.lit(0).cast("long")
    none = size.where("total = 0").select("conv_id", "total", nothing.alias("pos"), nothing.alias("a"), nothing.alias("b"), nothing.alias("words"))
    return head.union(own).union(none)


def _marks(pos: Column, a: Column, b: Column) -> list[Column]:
    """What a turn at a place adds to the sums."""
    halves = lambda x: [F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit((1 << 32) - 1))]
    return [*halves(F.xxhash64(pos, a, b)), *halves(F.xxhash64(pos, b, a))]


def _at_level(level: Column) -> Column:
    return F.element_at(F.array(*TURNS), F.greatest(level, F.lit(1)).cast("int"))


def _rolled(rows: DataFrame, cells: str) -> DataFrame:
    """ROLLUP over the columns of each block; level is the number of columns that are not rolled up."""
    keys = ", ".join(["block", *KEY])
    out = rows.sparkSession.sql(
        f"SELECT {keys}, {', '.join(TURNS)}, {WIDTH} - bit_count(grouping_id()) AS level, {cells} FROM {{rows}} GROUP BY {keys}, ROLLUP ({', '.join(TURNS)})", rows=rows)
    # Rows that end before a column are null there, which is no prefix.
    return out.where((F.col("level") == 0) | _at_level(F.col("level")).isNotNull())


def _ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of conversations that end at each node, as a stream: no list of them is held."""
    keys = ["depth", *SUMS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in now), pa.array([state.hexdigest()])], names=[*keys, "ends_sha256"])

        for b in batches:
            for *node, conv in zip(*(b.column(c).to_pylist() for c in [*keys, "conv_id"])):
                if node != now:
                    if now is not None:
                        yield row()
                    now, state = node, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
        if now is not None:
            yield row()

    schema = ", ".join(f"{c} long" for c in keys) + ", ends_sha256 string"
    return ends.repartition(*keys).sortWithinPartitions(*keys, "conv_id").mapInArrow(run, schema)


def _below(nodes: DataFrame, blocks: int) -> DataFrame:
    """For each node that blocks hang from (s1 .. s4 are the sums up to it): children, leaves and saved of all blocks below."""
    deep = nodes.where("block > 0").groupBy("block", *KEY).agg(
        F.count_if(F.col("level") == 1).alias("children"), F.sum(F.col("leaf").cast("long")).alias("leaves"), F.sum("saved").alias("saved"))
    up = nodes.where((F.col("level") == WIDTH) & (F.col("block") > 0)).select(
        (F.col("block") + 1).alias("block"), *[F.col(s).alias(k) for s, k in zip(SUMS, KEY)], F.struct((F.col("block")).alias("block"), *KEY).alias("up"))
    # A block right below the first one (block 1) has nothing to point to: the first block is the root's own.
    now = deep.join(up, ["block", *KEY], "left").select(F.struct("block", *KEY).alias("node"), "up", "children", "leaves", "saved")
    for _ in range(max(0, blocks - 2).bit_length()):
        now = stage(now)
        more = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        far = now.select(F.col("node").alias("up"), F.col("up").alias("far"))
        now = now.join(more, "node", "left").join(far, "up", "left").select(
            "node", F.col("far").alias("up"), "children", *[(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) for c in ("leaves", "saved")])
    return now.select(F.lit(WIDTH).alias("level"), *[F.col(f"node.{k}").alias(s) for s, k in zip(SUMS, KEY)], (F.col("node.block") - 1).alias("block"),
                      F.col("children").alias("below_children"), F.col("leaves").alias("below_leaves"), F.col("saved").alias("below_saved"))


def trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations, one row for each distinct sequence of first turns.

    ``turns`` has conv_id, total, pos, a, b, words (``rebuilt``). Returns conv_id (smallest member),
    depth, parent_conv_id (root: null), n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved_tokens (summed over the subtree: (n_convs - 1) times the words of the node's last turn),
    ends_sha256 (of the ids of conversations that end there), and s1 .. s4, which identify
    the node among those of its depth. No rows give no nodes.
    """
    marks = [m.alias(f"m{i}") for i, m in enumerate(_marks(F.col("pos"), F.col("a"), F.col("b")), 1)]
    marked = turns.select("*", *[F.when(F.col("pos") > 0, m).otherwise(0).alias(f"m{i}") for i, m in enumerate(marks, 1)])
    summed = stage(running_totals(marked, [F.col("pos")], {s: F.col(f"m{i}") for i, s in enumerate(SUMS, 1)}, ["conv_id"]))
    slot = (F.col("pos") - 1) % WIDTH
    block = F.greatest(F.floor((F.col("pos") - 1) / WIDTH), F.lit(0)).alias("block")
    turn = F.struct("a", "b", "words")
    rows = summed.groupBy("conv_id", "total", block).agg(
        *[F.max(F.when((slot == i) & (F.col("pos") > 0), turn)).alias(t) for i, t in enumerate(TURNS)],
        *[F.coalesce(F.max(F.when(slot == 0, F.col(s) - F.col(f"m{i}"))), F.lit(0)).alias(k) for i, (s, k) in enumerate(zip(SUMS, KEY), 1)])
    found = _rolled(rows, "count(*) AS n_convs, min(conv_id) AS conv_id, max(total) AS longest")
    level, depth = F.col("level").cast("long"), F.col("block") * WIDTH + F.col("level")
    parts = [_marks(F.col("block") * WIDTH + i, F.col(f"{t}.a"), F.col(f"{t}.b")) for i, t in enumerate(TURNS, 1)]
    inside = [F.when(F.col(t).isNotNull(), F.array(*p)) for t, p in zip(TURNS, parts)]
    last = _at_level(F.col("level"))["words"]
    nodes = found.where("level > 0 or block = 0").select(
        "block", *KEY, *TURNS, level.alias("level"), depth.alias("depth"), "n_convs", "conv_id", (F.col("longest") == depth).alias("leaf"),
        F.when(F.col("level") > 0, (F.col("n_convs") - 1) * last).otherwise(0).alias("saved"),
        *[(F.col(k) + reduce(add, [F.coalesce(p[n], F.lit(0)) for p in inside])).alias(s) for n, (k, s) in enumerate(zip(KEY, SUMS))])
    nodes = stage(nodes)
    blocks = (nodes.agg(F.max("block")).first()[0] or 0) + 1
    valued = nodes.join(_below(nodes, blocks), ["block", "level", *SUMS], "left").select(
        "block", *KEY, *TURNS, F.col("level").alias("own_level"), "n_convs", "conv_id", F.coalesce("below_children", F.lit(0)).alias("below_children"),
        *[(F.col(o).cast("long") + F.coalesce(f"below_{c}", F.lit(0))).alias(c) for o, c in (("leaf", "leaves"), ("saved", "saved"))])
    children = ", ".join(f"count_if(own_level = {i + 1}) AS c{i}" for i in range(WIDTH))
    # A node's members are those of its subtree, so the group's largest count and smallest id are its own.
    out = _rolled(valued, f"max(n_convs) AS n_convs, min(conv_id) AS conv_id, sum(leaves) AS n_leaves, sum(saved) AS saved_tokens, max(below_children) AS below_children, {children}")
    here = F.element_at(F.array(*[f"c{i}" for i in range(WIDTH)], "below_children"), (F.col("level") + 1).cast("int"))
    totals = [reduce(add, [F.coalesce(p[n], F.lit(0)) for p in inside]) for n in range(4)]
    own = [F.coalesce(F.element_at(F.array(*inside), F.greatest(F.col("level"), F.lit(1)).cast("int"))[n], F.lit(0)) for n in range(4)]
    out = out.where("level > 0 or block = 0").select(
        "conv_id", depth.alias("depth"), "n_convs", here.cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        *[(F.col(k) + t).alias(s) for k, t, s in zip(KEY, totals, SUMS)], *[(F.col(k) + t - o).alias(f"up_{s}") for k, t, o, s in zip(KEY, totals, own, SUMS)])
    out = stage(out)
    root = F.broadcast(out.where("depth = 0").select(F.col("conv_id").alias("root_conv_id")))  # one row
    up = out.where("depth > 0").select((F.col("depth") + 1).alias("depth"), *[F.col(s).alias(f"up_{s}") for s in SUMS], F.col("conv_id").alias("parent"))
    ends = _ends(summed.where("pos = total").select("conv_id", F.col("total").alias("depth"), *SUMS))
    near = out.where("depth <= 1").crossJoin(root).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("root_conv_id"))).drop("root_conv_id")
    deep = out.where("depth > 1").join(up, ["depth", *[f"up_{s}" for s in SUMS]], "left").withColumnRenamed("parent", "parent_conv_id")
    both = near.unionByName(deep).join(ends, ["depth", *SUMS], "left")
    return both.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), *SUMS)


def sql() -> str:
    """The rebuilt conversations' trie in DuckDB, by lists of turns."""
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)), "
           "lambda v, x: list_reduce(list_prepend(xor(v, x), range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)")
    return rf"""
    WITH turns AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
                   FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    heads AS (SELECT *, {crc} % 4 AS h FROM turns),
    whole AS (SELECT a.c, list_concat(CASE WHEN a.h > 0 THEN coalesce(b.own, [])[1:a.h] ELSE [] END, a.own[a.h + 1:]) AS seq FROM heads a LEFT JOIN turns b ON b.c = a.c - a.c % 20),
    prefixes AS (SELECT c, len(seq) AS n, d, seq[1:d] AS p FROM whole, unnest(range(0, len(seq) + 1)) AS u(d)),
    nodes AS (SELECT p, d, count(*) AS n_convs, min(c) AS conv_id, max(n) = d AS leaf, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends,
                     (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].x, '[^\x20\x09-\x0D]+')) END AS saved FROM prefixes GROUP BY p, d),
    above AS (SELECT p[1:k] AS q, sum(leaf::INT) AS n_leaves, sum(saved) AS saved_tokens, count(*) FILTER (k = d - 1) AS n_children FROM nodes, unnest(range(0, d + 1)) AS u(k) GROUP BY q)
    SELECT n.conv_id, n.d AS depth, o.conv_id AS parent_conv_id, n.n_convs, a.n_children, a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM nodes n JOIN above a ON a.q = n.p LEFT JOIN nodes o ON n.d > 0 AND o.d = n.d - 1 AND o.p = n.p[1:n.d - 1]"""
