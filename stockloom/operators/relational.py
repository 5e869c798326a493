"""Joins, aggregates and windows used across the analyses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.functions.clean import ratio
from stockloom.operators.ordering import quantiles, quantiles_long, running_totals


# -- joins --------------------------------------------------------------------

def orphans(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Distinct fact keys without a dimension row."""
    return fact.select(key).distinct().join(dimension.select(key), key, "left_anti")


def match_rate(fact: DataFrame, dimension: DataFrame, key: str, threshold: float = 98.0) -> DataFrame:
    """One row: share of fact rows whose key exists in the dimension.

    Rows are counted per key before the join, so a hot key is one row of it.
    """
    per_key = fact.groupBy(key).agg(F.count("*").alias("_n"))
    known = dimension.select(key).distinct().withColumn("_known", F.lit(1))
    joined = per_key.join(known, key, "left")
    out = joined.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("unmatched"),
    )
    rate = F.col("matched") * 100.0 / F.nullif(F.col("n_rows"), F.lit(0))
    return out.withColumn("matched", F.col("n_rows") - F.col("unmatched")).select(
        F.lit(key).alias("key"), "n_rows", "unmatched", rate.alias("match_pct"), (rate >= threshold).alias("passed")
    )


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """All rows of ``n`` keys: those with the smallest MD5 of their text (repeatable, in other engines too)."""
    chosen = df.select(key).distinct().orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)
    return df.join(chosen, key, "left_semi")


# -- aggregates ---------------------------------------------------------------

def column_stats(df: DataFrame, columns: list[str], stats: dict[str, Callable[[Column], Column]], by: list[str] | None = None) -> DataFrame:
    """``stats`` of every column as doubles, long form: (by…, feature, stats…).

    One aggregation makes all of them side by side; only its result, one row per
    group, is turned into rows.
    """
    by = list(by or [])
    cells = [make(F.col(c).cast("double")).alias(f"_{i}_{n}") for i, c in enumerate(columns) for n, make in stats.items()]
    rows = [F.struct(F.lit(c).alias("feature"), *[F.col(f"_{i}_{n}").alias(n) for n in stats]) for i, c in enumerate(columns)]
    return df.groupBy(*by).agg(*cells).select(*by, F.explode(F.array(*rows)).alias("_row")).select(*by, "_row.*")


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column, long form."""
    by = list(by or [])
    groups = [*by, "feature"]
    moments = column_stats(df, columns, {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}, by)
    long = quantiles_long(df, columns, [0.25, 0.5, 0.75], by)
    cells = [F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    return moments.join(long.groupBy(*groups).agg(*cells), groups, "left")


def value_counts(df: DataFrame, column: str, top: int | None = 30) -> DataFrame:
    """Values by frequency with percent of rows; NULL is a value."""
    counted = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("_total"))
    out = counted.crossJoin(F.broadcast(total)).select(
        "value", "n", (F.col("n") * 100.0 / F.col("_total")).alias("pct")
    )
    if top is None:
        return out
    return out.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(top)


def contingency(df: DataFrame, rows: str, column: str, values: list, count: Column) -> DataFrame:
    """Pivot with explicit column values; absent cells are 0."""
    return df.groupBy(rows).pivot(column, values).agg(count).fillna(0)


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Value over the grand total, as a broadcast one-row total."""
    total = df.agg(F.sum(value).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, ratio(F.col(value), F.col("_total"))).drop("_total")


def share_in_group(df: DataFrame, value: str, group: list[str], name: str = "share") -> DataFrame:
    """Value over its group total.

    The totals come from a map-side combined aggregation and a join, so one hot
    group does not gather in one window task.
    """
    totals = df.groupBy(*group).agg(F.sum(value).alias("_total"))
    return df.join(totals, group, "left").withColumn(name, ratio(F.col(value), F.col("_total"))).drop("_total")


def skewness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population skewness per column, long form."""
    return column_stats(df, columns, {"skewness": F.skewness})


def histogram(df: DataFrame, column: str, bins: int, low: Column, high: Column, bounds: DataFrame) -> DataFrame:
    """Counts in equal bins over [low, high]; values at ``high`` go to the last bin.

    ``bounds`` is a one-row frame that holds the columns of ``low`` and ``high``;
    values outside the range are left out.
    """
    x = F.col(column).cast("double")
    width = (high - low) / F.lit(float(bins))
    binned = df.select(column).crossJoin(F.broadcast(bounds)).where((x >= low) & (x <= high)).select(
        F.least(F.floor(F.coalesce(F.try_divide(x - low, width), F.lit(0.0))), F.lit(bins - 1)).alias("bin"),
        low.alias("_low"), width.alias("_width"),
    )
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.max("_low").alias("_low"), F.max("_width").alias("_width")).select(
        "bin", (F.col("_low") + F.col("bin") * F.col("_width")).alias("bin_start"), "n"
    )


def winsorise(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, suffix: str = "_winsor") -> DataFrame:
    """Clip to exact quantiles, attached as a one-row frame."""
    edges = quantiles(df, columns, [low, high])
    tags = f"_p{round(low * 100):02d}", f"_p{round(high * 100):02d}"
    out = df.crossJoin(F.broadcast(edges))
    out = out.withColumns({
        c + suffix: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.col(c + tags[0])), F.col(c + tags[1])))
        for c in columns
    })
    return out.drop(*[c + t for c in columns for t in tags])


# -- windows ------------------------------------------------------------------

def trailing(keys: list[str], n: int, order: str = "year_month"):
    """Window of the current and the ``n`` - 1 earlier months of a series."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)


def centred_mean(value: Column, keys: list[str], n: int, order: str = "year_month") -> Column:
    """Centred moving average, NULL unless all ``n`` months are there.

    Even windows reach one month further back than forward.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n // 2), (n - 1) // 2)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def percent_change(value: Column, keys: list[str], lag: int, order: str = "year_month") -> Column:
    before = F.lag(value, lag).over(Window.partitionBy(*keys).orderBy(order))
    return ratio(value - before, before) * 100


def last_seen(value: Column, keys: list[str], order: str = "year_month") -> Column:
    """Forward fill."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def ranked_share(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Share, cumulative share and rank by descending value (ties by key).

    Shares are exact for decimal and integer values: the cumulative share is one
    division of a running total.
    """
    total = df.agg(F.sum(value).alias("_total"))
    ordered = running_totals(
        df, [(-F.col(value)).alias("_neg"), *[F.col(k) for k in key]],
        {"_running": F.col(value), "rank": F.lit(1).cast("bigint")},
    )
    return ordered.crossJoin(F.broadcast(total)).withColumns({
        "share": ratio(F.col(value), F.col("_total")),
        "cumulative_share": ratio(F.col("_running"), F.col("_total")),
    }).drop("_total", "_running")


