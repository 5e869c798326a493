"""Global order without a global task: running totals, ranks, exact quantiles.

``Window.orderBy`` without ``partitionBy`` sends every row to one task, and the
built-in exact percentile keeps all distinct values of a group in one buffer.
The operators here range-partition the rows by group and order first, into as
many ranges as their number asks for. A large group lies in many ranges, and
small groups share one; each range carries on the sums of those before it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.sources.staging import stage

ROWS_PER_RANGE = 200_000
#: A sketched rank is off by at most one row in so many.
ACCURACY = 4000


def running_totals(
    df: DataFrame,
    order: list[Column],
    totals: dict[str, Column],
    by: list[str] | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    staged: bool = True,
) -> DataFrame:
    """Add inclusive running sums along ``order`` (ascending), one per group of ``by``.

    ``order`` must identify rows within a group; ``totals`` maps new column names
    to the summed expressions. A range has about ``rows_per_range`` rows, whatever
    the groups' sizes. Ranges are staged, because two passes must see the same ones.
    """
    by = list(by or [])
    names = list(totals)
    keyed = df.select(
        "*",
        F.struct(*[F.col(c) for c in by], *order).alias("_key"),
        *[c.alias(f"_add_{n}") for n, c in totals.items()],
    )
    if staged:
        keyed = stage(keyed)
    ranges = -(-keyed.count() // rows_per_range)
    if ranges > 1:
        placed = stage(keyed.repartitionByRange(ranges, "_key").withColumn("_range", F.spark_partition_id()))
    else:
        placed = keyed.withColumn("_range", F.lit(0))
    share = placed.groupBy(*by, "_range").agg(*[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in names])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = share.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_range").alias("_at"),
        *[F.sum(f"_sum_{n}").over(earlier).alias(f"_carry_{n}") for n in names],
    )
    match = F.col("_range") == F.col("_at")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy(*by, "_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    within = placed.withColumns({f"_in_{n}": F.sum(f"_add_{n}").over(inside) for n in names})
    out = within.join(carried, match).withColumns({
        n: F.col(f"_in_{n}") + F.coalesce(F.col(f"_carry_{n}"), F.lit(0)) for n in names
    })
    return out.select(*df.columns, *names)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """1-based position along ``order``."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, by)


def long_values(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """One row per (group, column name, value), values as doubles."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    keys = list(by or [])
    return df.select(*keys, F.expr(f"stack({len(columns)}, {pairs}) as (feature, value)"))


def quantiles_long(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None,
    accuracy: int = ACCURACY, few_rows: int | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles: (by…, feature, prob, n, quantile).

    A mergeable sketch of each column brackets every quantile between two of its
    values. A second pass counts the values up to either end, and only those strictly
    between are gathered and ordered: about 4 / ``accuracy`` of a large group's rows for
    each probability, however many copies the ends have. A group of few rows is bracketed by its
    extremes. The counts prove each bracket; should one fail, all values are ordered, as they
    are from the start in a table of at most ``few_rows`` rows, which one range holds.
    """
    by = list(by or [])
    narrow = stage(df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]))
    if few_rows is None:
        few_rows = ROWS_PER_RANGE
    if narrow.count() <= few_rows:
        return quantiles_by_order(narrow, columns, probs, by)
    shares = [min(1.0, max(0.0, p + shift / accuracy)) for p in probs for shift in (-2, 2)]
    sketch = narrow.groupBy(*by).agg(*[F.struct(
        F.count(c).alias("n"), F.min(c).alias("least"), F.max(c).alias("most"), F.percentile_approx(c, shares, accuracy).alias("at")).alias(f"_s{k}") for k, c in enumerate(columns)])

    def edge(s: str, side: int, name: str) -> Column:
        wide = F.col(f"{s}.n") > 2 * accuracy
        return F.array(*[F.when(wide, F.col(f"{s}.at")[2 * j + side]).otherwise(F.col(f"{s}.{name}")) for j in range(len(probs))])

    ends = stage(sketch.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.array(*[F.struct(
        F.col(f"_s{k}.n").alias("n"), edge(f"_s{k}", 0, "least").alias("low"), edge(f"_s{k}", 1, "most").alias("high")) for k in range(len(columns))]).alias("_ends")))
    if by:
        placed = narrow.join(ends, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]))
    else:
        placed = narrow.crossJoin(F.broadcast(ends))  # one row
    cells = ", ".join(f"{k}, `{c}`, _ends[{k}]" for k, c in enumerate(columns))
    long = placed.select(*by, F.expr(f"stack({len(columns)}, {cells}) as (_c, value, _e)")).where("value is not null")
    value, sides = F.col("value"), [(F.col("_e.low")[j], F.col("_e.high")[j]) for j in range(len(probs))]
    counts = long.groupBy(*by, "_c").agg(F.any_value("_e").alias("_e"), *[F.count_if(x).alias(f"_{j}_{n}") for j, (low, high) in enumerate(sides) for n, x in (
        ("below", value < low), ("from", value <= low), ("to", value < high), ("upto", value <= high))])
    groups = [*by, "_c", "_p"]
    wanted = counts.select(*by, "_c", F.explode(F.array(*[F.struct(
        F.lit(j).alias("_p"), F.lit(float(p)).alias("prob"), F.col("_e.n").alias("n"), F.col("_e.low")[j].alias("_low"), F.col("_e.high")[j].alias("_high"),
        *[F.col(f"_{j}_{x}").alias(f"_{x}") for x in ("below", "from", "to", "upto")]) for j, p in enumerate(probs)])).alias("_x"))
    wanted = wanted.select(*by, "_c", F.element_at(F.array(*map(F.lit, columns)), F.col("_c") + 1).alias("feature"), "_x.*").withColumn("_pos", F.col("prob") * (F.col("n") - 1))
    wanted = stage(wanted.withColumns({"_lo": F.floor("_pos"), "_hi": F.ceil("_pos")}))
    if wanted.where((F.col("_below") > F.col("_lo")) | (F.col("_upto") <= F.col("_hi"))).limit(1).count():
        return quantiles_by_order(narrow, columns, probs, by)
    between = [(value > low) & (value < high) for low, high in sides]
    hits = F.array(*[F.when(x, F.lit(j)) for j, x in enumerate(between)])
    inside = long.where(reduce(or_, between)).select(*by, "_c", "value", F.explode(F.array_compact(hits)).alias("_p"))
    inside = inside.groupBy(*groups, "value").agg(F.count("*").alias("copies"))
    ranked = running_totals(inside, [F.col("value")], {"_until": F.col("copies")}, groups)
    spans = ranked.select(*[F.col(c).alias(f"_by_{c}") for c in groups], "value", (F.col("_until") - F.col("copies")).alias("_since"), "_until")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in groups])
    holds = {x: (F.col(x) - F.col("_from") >= F.col("_since")) & (F.col(x) - F.col("_from") < F.col("_until")) for x in ("_lo", "_hi")}
    met = wanted.join(spans, same & (holds["_lo"] | holds["_hi"])).groupBy(*groups).agg(
        *[F.max(F.when(x, F.col("value"))).alias(f"{n}_in") for n, x in holds.items()])
    out = wanted.join(met.withColumnsRenamed({c: f"_by_{c}" for c in groups}), same, "left")
    at = {x: F.when(F.col(x) < F.col("_from"), F.col("_low")).when(F.col(x) >= F.col("_to"), F.col("_high")).otherwise(F.col(f"{x}_in")) for x in ("_lo", "_hi")}
    frac = F.col("_pos") - F.floor("_pos")
    return out.select(*by, "feature", "prob", "n", (at["_lo"] + (at["_hi"] - at["_lo"]) * frac).alias("quantile"))


def quantiles_by_order(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None
) -> DataFrame:
    """The quantiles of ``quantiles_long`` from a range sort of all distinct values."""
    by = list(by or [])
    groups = [*by, "feature"]
    counted = (
        long_values(df, columns, by).where("value is not null")
        .groupBy(*groups, "value").agg(F.count("*").alias("copies"))
    )
    ranked = running_totals(counted, [F.col("value")], {"upto": F.col("copies")}, groups)
    spans = ranked.withColumn("_from", F.col("upto") - F.col("copies"))
    sizes = ranked.groupBy(*groups).agg(F.max("upto").alias("n"))
    wanted = sizes.select(*groups, "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    wanted = wanted.withColumn("_pos", F.col("prob") * (F.col("n") - 1))
    if not by:
        wanted = F.broadcast(wanted)  # one row per column and probability
    s, q = spans.alias("s"), wanted.alias("q")
    same = F.lit(True)
    for c in groups:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"q.{c}"))
    low, high = F.floor("q._pos"), F.ceil("q._pos")
    holds_low = (F.col("s._from") <= low) & (low < F.col("s.upto"))
    holds_high = (F.col("s._from") <= high) & (high < F.col("s.upto"))
    hit = s.join(q, same & (holds_low | holds_high))
    picked = hit.groupBy(*[F.col(f"q.{c}").alias(c) for c in groups], F.col("q.prob").alias("prob"),
                         F.col("q.n").alias("n"), F.col("q._pos").alias("_pos")).agg(
        F.max(F.when(holds_low, F.col("s.value"))).alias("_lo"),
        F.max(F.when(holds_high, F.col("s.value"))).alias("_hi"),
    )
    frac = F.col("_pos") - F.floor("_pos")
    return picked.select(
        *groups, "prob", "n", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias("quantile")
    )


def quantiles(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None
) -> DataFrame:
    """Wide form: one row per group with columns ``<column>_p<percent>``."""
    by = list(by or [])
    long = quantiles_long(df, columns, probs, by)
    cells = [
        F.max(F.when((F.col("feature") == c) & (F.col("prob") == float(p)), F.col("quantile")))
        .alias(f"{c}_p{round(p * 100):02d}")
        for c in columns for p in probs
    ]
    return long.groupBy(*by).agg(*cells) if by else long.agg(*cells)


def average_ranks(df: DataFrame, value: str, counts: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Distinct values with tie-averaged ranks.

    Returns (by…, value, n_tied, <counts…>, avg_rank): rows with equal values
    share the mean of the positions they occupy.
    """
    by = list(by or [])
    tied = df.groupBy(*by, value).agg(
        F.count("*").alias("n_tied"), *[c.alias(n) for n, c in counts.items()]
    )
    upto = running_totals(tied, [F.col(value)], {"_upto": F.col("n_tied")}, by)
    return upto.withColumn("avg_rank", F.col("_upto") - (F.col("n_tied") - 1) / 2).drop("_upto")
