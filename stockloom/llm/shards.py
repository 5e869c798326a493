"""Sharding by a hierarchical weighted hash tree.

A row's key descends region, rack and shard. On each level every child draws a
straw ``-ln(u) / weight``, with ``u`` from a hash of key and child, and the
shortest straw wins; a child wins with probability weight / sum of weights,
independently of the number of its siblings.

A shard that is added later, or weight that an old shard gains, is a *growth*
of the tree: it draws a straw of its own, and each subtree above it draws the
shorter of its old straw and that one. (The minimum of exponential draws is an
exponential draw of the summed weight, so shares stay in proportion.) Rows
therefore move only inside the subtrees whose weight grew, and only into the
grown shard. Nothing is shuffled: place and move are expressions of the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import free_name, stage


@dataclass(frozen=True)
class Leaf:
    """A shard, its place in the tree, and its weight."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """``base`` leaves, and ``growth`` added since, in any order."""

    base: Sequence[Leaf]
    growth: Sequence[Leaf] = field(default=())

    @staticmethod
    def even(shards: int, per_rack: int = 5, racks_per_region: int = 4) -> Tree:
        return Tree([Leaf(s, f"region{s // (per_rack * racks_per_region)}", f"rack{s // per_rack}") for s in range(shards)])

    def grown(self, *leaves: Leaf) -> Tree:
        return Tree(self.base, (*self.growth, *leaves))


def _straw(key: Column, place: Column | str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(place)), 11).cast("double") + 0.5) * 2.0**-53
    return -F.log(u) / weight


def _shortest(options: list[Column]) -> Column:
    return options[0] if len(options) == 1 else F.least(*options)


def _child(key: Column, level: str, weights: dict[str, float]) -> Column:
    """(straw, child): the shortest straw among the children."""
    return _shortest([F.struct(_straw(key, f"{level}/{name}", w).alias("straw"), F.lit(i).alias("child")) for i, (name, w) in enumerate(weights.items())])


def _sums(leaves: Sequence[Leaf], name) -> dict[str, float]:
    out: dict[str, float] = {}
    for x in leaves:
        if x.weight > 0:
            out[name(x)] = out.get(name(x), 0.0) + x.weight
    return out


def _branch(drawn: Column, parts: list[Column]) -> Column:
    out = F.when(drawn == 0, parts[0])
    for i, part in enumerate(parts[1:], 1):
        out = out.when(drawn == i, part)
    return out


def place(df: DataFrame, key: str, base: Sequence[Leaf], growths: dict[str, Sequence[Leaf]]) -> DataFrame:
    """``df`` with a column for each of ``growths``: the shard of ``key`` in the tree of ``base`` so grown.

    A null key is a key like any other: all its rows share one shard. Weights of 0
    or less draw no straw. Each level is a column of its own, so draws are made once.
    """
    k, names = F.col(key), [free_name(df, f"{level}_drawn") for level in ("region", "rack", "leaf")]
    regions = _sums(base, lambda x: x.region)
    racks = {r: _sums([x for x in base if x.region == r], lambda x: x.rack) for r in regions}
    leaves = {(r, q): _sums([x for x in base if (x.region, x.rack) == (r, q)], lambda x: str(x.shard)) for r in regions for q in racks[r]}
    region, rack, leaf = (F.col(c) for c in names)
    out = df.withColumn(names[0], _child(k, "region", regions))
    out = out.withColumn(names[1], _branch(region["child"], [_child(k, f"rack/{r}", racks[r])["child"] for r in regions]))
    shard = _branch(region["child"], [_branch(rack, [_branch(_child(k, f"shard/{r}/{q}", leaves[r, q])["child"], [F.lit(int(s)) for s in leaves[r, q]]) for q in racks[r]]) for r in regions])
    out = out.withColumn(names[2], shard)
    for name, grown in growths.items():
        straws = [F.struct(_straw(k, f"growth/{n}/{x.region}/{x.rack}/{x.shard}", x.weight).alias("straw"), F.lit(x.shard).alias("shard")) for n, x in enumerate(grown) if x.weight > 0]
        # A region's straw is the shortest of its old one and those of the growth below it, so the shortest of all decides.
        out = out.withColumn(name, (F.when(_shortest(straws)["straw"] < region["straw"], _shortest(straws)["shard"]).otherwise(leaf) if straws else leaf).cast("int"))
    return out.drop(*names)


def assign(df: DataFrame, key: str, tree: Tree, grown: Tree, order: Sequence[str]) -> DataFrame:
    """``df`` with shard, slot and grown_shard (the shard under ``grown``, which has the base of ``tree``).

    Slots number a shard's rows from 0 without a gap. They are given inside each
    (shard, input task), in the order of ``order``, and moved on by the counts of the
    tasks before; no task holds more than an input task's rows, whatever the
    keys. Equal rows take any of their slots. An empty table gives no rows.
    Columns of the names shard, slot and grown_shard are replaced.
    """
    df = df.drop("shard", "slot", "grown_shard")
    part, first = free_name(df, "part"), free_name(df, "first_slot")
    placed = stage(place(df, key, tree.base, {"shard": tree.growth, "grown_shard": grown.growth}).withColumn(part, F.spark_partition_id()))
    sizes = placed.groupBy("shard", part).agg(F.count("*").alias(first))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(first, F.coalesce(F.sum(first).over(before), F.lit(0)))
    inside = Window.partitionBy("shard", part).orderBy(*[F.col(c) for c in order])
    return (
        placed.withColumn("slot", F.row_number().over(inside).cast("long") - 1).join(starts, ["shard", part])
        .withColumn("slot", F.col("slot") + F.col(first)).drop(part, first)
    )


def write_shards(df: DataFrame, key: str, tree: Tree, path: str) -> None:
    """Write every row of ``df``, all columns, below ``path``/shard=N."""
    place(df.drop("shard"), key, tree.base, {"shard": tree.growth}).write.partitionBy("shard").parquet(path)
