"""Outlet profiling and segmentation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from stockloom.functions.clean import log1p_or_null, ratio
from stockloom.operators import clusters
from stockloom.operators.ordering import quantiles
from stockloom.operators.reduce import correlation_matrix
from stockloom.operators.relational import column_stats, winsorise
from stockloom.sources.staging import stage

NUMERIC = [
    "total_net_sales", "total_quantity", "active_months", "loyalty_ratio", "avg_txn_per_active_month", "avg_net_sales_per_txn",
    "avg_qty_per_txn", "n_unique_skus", "n_unique_categories", "return_rate", "recency_months", "momentum", "pct_cash_txn",
]
LOGGED = ["total_net_sales", "total_quantity", "avg_net_sales_per_txn", "avg_qty_per_txn"]
CLUSTER_INPUT = [
    "avg_txn_per_active_month", "n_unique_categories", "return_rate", "pct_cash_txn",
    "avg_net_sales_per_txn_log", "avg_qty_per_txn_log", "momentum_winsor",
]
HIGH, LOW = "High-Value Active", "Low-Value Sporadic"


def active_split(outlets: DataFrame) -> DataFrame:
    """Outlets per state."""
    state = F.when(F.col("is_active"), "Active").otherwise("Churned")
    return outlets.groupBy(state.alias("state")).agg(F.count("*").alias("n_outlets"), F.sum("total_net_sales").alias("total_net_sales"))


def normality(outlets: DataFrame, features: list[str] = NUMERIC) -> DataFrame:
    """Omnibus normality test from skewness and kurtosis, per feature.

    NULL for constant features. The tail of the statistic (two degrees of
    freedom) is exp(-K2 / 2).
    """
    m = column_stats(outlets, features, {"n": lambda c: F.count(c).cast("double"), "g1": F.skewness, "b2": lambda c: F.kurtosis(c) + 3})
    n = F.col("n")
    # skewness: transformed to normal (D'Agostino 1970)
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    u = y * F.sqrt((w2 - 1) / 2)
    z1 = delta * F.log(u + F.sqrt(u * u + 1))
    # kurtosis: Anscombe and Glynn (1983)
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("b2") - mean) / F.sqrt(var)
    skew = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / skew * (2 / skew + F.sqrt(1 + 4 / (skew * skew)))
    t2 = 1 + x * F.sqrt(2 / (a - 4))
    cube = (1 - 2 / a) / F.abs(t2)
    z2 = ((1 - 2 / (9 * a)) - F.signum(t2) * F.pow(cube, F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    usable = (n > 8) & F.col("g1").isNotNull()
    return m.select(
        "feature", F.col("g1").alias("skewness"), F.when(usable, k2).alias("statistic"),
        F.when(usable, F.exp(-k2 / 2)).alias("p_value"), F.when(usable, F.exp(-k2 / 2) > 0.05).alias("is_normal"))


def iqr_flags(outlets: DataFrame, features: list[str] = NUMERIC, multiplier: float = 3.0) -> DataFrame:
    """Flag per feature beyond the IQR fence, and the number of flags."""
    edges = quantiles(outlets, features, [0.25, 0.75])
    out = outlets.crossJoin(F.broadcast(edges))
    flags = {}
    for c in features:
        lo, hi = F.col(f"{c}_p25"), F.col(f"{c}_p75")
        x = F.col(c).cast("double")
        flags[f"{c}_outlier"] = F.coalesce((x < lo - multiplier * (hi - lo)) | (x > hi + multiplier * (hi - lo)), F.lit(False))
    count = sum((F.col(f"{c}_outlier").cast("int") for c in features), F.lit(0))
    return out.withColumns(flags).withColumn("outlier_count", count).drop(*[f"{c}_p{p}" for c in features for p in (25, 75)])


def structural_share(flagged: DataFrame, least: int = 3) -> DataFrame:
    """Number and revenue share of outlets with at least ``least`` flags."""
    hit = F.col("outlier_count") >= least
    out = flagged.agg(
        F.count("*").alias("n_outlets"), F.count_if(hit).alias("n_structural"),
        F.coalesce(F.sum(F.when(hit, F.col("total_net_sales"))), F.lit(0)).alias("_h"), F.sum("total_net_sales").alias("_t"))
    return out.select("n_outlets", "n_structural", ratio(F.col("_h"), F.col("_t")).alias("revenue_share"))


def calm_outlets(outlets: DataFrame, most: int = 2) -> DataFrame:
    """Outlets with at most ``most`` flags, the population that transforms and collinearity are judged on."""
    return iqr_flags(outlets).where(F.col("outlier_count") <= most).select(*outlets.columns)


def transform(outlets: DataFrame) -> DataFrame:
    """log1p of the skewed features (negatives as 0) and winsorised momentum."""
    logs = {f"{c}_log": log1p_or_null(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in LOGGED}
    return winsorise(outlets.withColumns(logs), ["momentum"])


def skew_change(transformed: DataFrame) -> DataFrame:
    """Skewness before and after the transforms."""
    pairs = [*[(c, f"{c}_log") for c in LOGGED], ("momentum", "momentum_winsor")]
    row = transformed.agg(*[F.skewness(F.col(c).cast("double")).alias(c) for pair in pairs for c in pair])
    cells = ", ".join(f"'{a}', `{a}`, `{b}`" for a, b in pairs)
    return row.select(F.expr(f"stack({len(pairs)}, {cells}) as (feature, skew_before, skew_after)"))


def variance_inflation(corr: np.ndarray) -> np.ndarray:
    """VIF of each feature: the diagonal of the inverted correlation matrix."""
    return np.diag(np.linalg.pinv(np.asarray(corr, dtype=float)))


def drop_collinear(outlets: DataFrame, features: list[str], limit: float = 5.0) -> tuple[dict[str, float], list[str]]:
    """Drop the feature of largest VIF until none exceeds ``limit``.

    Returns (VIF of kept features, dropped in order). Data is read once for the
    correlation matrix; the loop works on its sub-matrices.
    """
    names, corr = correlation_matrix(outlets.select(*features), features)
    kept, dropped = list(range(len(names))), []
    while True:
        vif = variance_inflation(corr[np.ix_(kept, kept)])
        if len(kept) < 2 or vif.max() <= limit:
            return {names[j]: float(v) for j, v in zip(kept, vif)}, dropped
        dropped.append(names[kept.pop(int(vif.argmax()))])


def standardise(df: DataFrame, features: list[str]) -> DataFrame:
    """(x - mean) / population deviation; constant features become 0."""
    cells = [f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in features for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]
    stats = df.agg(*cells)
    out = df.crossJoin(F.broadcast(stats))
    scaled = {c: F.coalesce(F.try_divide(F.col(c).cast("double") - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in features}
    return out.withColumns(scaled).drop(*[f"_{n}_{c}" for c in features for n in "ms"])


def power_split(outlets: DataFrame, multiplier: float = 3.0) -> DataFrame:
    """Segment column: Churned, Power (sales above the fence of active outlets) or Mainstream."""
    edges = quantiles(outlets.where("is_active"), ["total_net_sales"], [0.25, 0.75]).toDF("_q1", "_q3")
    fence = F.col("_q3") + multiplier * (F.col("_q3") - F.col("_q1"))
    name = (
        F.when(~F.col("is_active"), "Churned").when(F.col("total_net_sales").cast("double") > fence, "Power").otherwise("Mainstream"))
    return outlets.crossJoin(F.broadcast(edges)).withColumn("segment", name).drop("_q1", "_q3")


def segment_shares(split: DataFrame, name: str = "segment") -> DataFrame:
    from stockloom.operators.relational import share_of_total

    sums = split.groupBy(name).agg(F.count("*").alias("n_outlets"), F.sum("total_net_sales").alias("total_net_sales"))
    return share_of_total(sums, "total_net_sales", "revenue_share")


def clustering_input(mainstream: DataFrame) -> DataFrame:
    """Seven scaled features: two logs, winsorised momentum, four as they are."""
    logs = {f"{c}_log": log1p_or_null(F.col(c)) for c in ("avg_net_sales_per_txn", "avg_qty_per_txn")}
    ready = winsorise(mainstream.withColumns(logs), ["momentum"])
    return standardise(ready.select("outlet_id", *CLUSTER_INPUT), CLUSTER_INPUT)


def k_sweep(scaled: DataFrame, ks: range = range(1, 11), seed: int = 42, starts: int = 10) -> DataFrame:
    """Inertia per k and, from two clusters on, the silhouette (squared Euclidean); the cheapest of ``starts`` seeded starts.

    All starts of all k are fitted together, one pass over the outlets for each step.
    """
    rows = stage(scaled.select(*CLUSTER_INPUT))
    found = clusters.best_of(rows, CLUSTER_INPUT, list(ks), starts, seed)
    score = clusters.silhouettes(rows, CLUSTER_INPUT, {k: f for k, f in found.items() if k > 1})
    return scaled.sparkSession.createDataFrame([(k, f.cost, float(score.get(k, 0.0))) for k, f in found.items()], "k int, inertia double, silhouette double")


def best_kmeans(scaled: DataFrame, k: int = 2, starts: int = 20, seed: int = 42) -> np.ndarray:
    """Centres of the cheapest of several seeded starts, which are fitted together."""
    return clusters.best_of(stage(scaled.select(*CLUSTER_INPUT)), CLUSTER_INPUT, [k], starts, seed)[k].centres


def assign(centres: np.ndarray, scaled: DataFrame) -> DataFrame:
    return clusters.nearest(scaled, CLUSTER_INPUT, centres).select("outlet_id", "cluster")


def name_clusters(assigned: DataFrame, outlets: DataFrame) -> DataFrame:
    """Two clusters named by mean sales: the larger one is the high-value segment."""
    joined = assigned.join(outlets.select("outlet_id", "total_net_sales"), "outlet_id")
    means = joined.groupBy("cluster").agg(F.avg(F.col("total_net_sales").cast("double")).alias("m"))
    top = means.agg(F.max_by("cluster", "m").alias("_top"))
    named = assigned.crossJoin(F.broadcast(top))
    return named.select("outlet_id", "cluster", F.when(F.col("cluster") == F.col("_top"), HIGH).otherwise(LOW).alias("cluster_definition"))


def cluster_profile(assigned: DataFrame, outlets: DataFrame, features: list[str]) -> DataFrame:
    return assigned.join(outlets, "outlet_id").groupBy("cluster").agg(
        F.count("*").alias("n_outlets"), *[F.avg(F.col(c).cast("double")).alias(c) for c in features])


def cluster_by_place(assigned: DataFrame, outlets: DataFrame, place: str, values: list[str]) -> DataFrame:
    from stockloom.operators.relational import contingency

    return contingency(assigned.join(outlets.select("outlet_id", place), "outlet_id"), "cluster", place, values, F.count(F.lit(1)))


def segments(outlets: DataFrame, starts: int = 20, seed: int = 42) -> DataFrame:
    """outlet_id and cluster_definition for every outlet."""
    split = stage(power_split(outlets))
    scaled = clustering_input(split.where("segment = 'Mainstream'"))
    named = name_clusters(assign(best_kmeans(scaled, 2, starts, seed), scaled), outlets).select("outlet_id", "cluster_definition")
    rest = split.where("segment <> 'Mainstream'").select("outlet_id", F.col("segment").alias("cluster_definition"))
    return rest.unionByName(named)
