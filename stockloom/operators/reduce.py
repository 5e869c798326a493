"""Matrix reduction: activity filter, correlation, greedy feature removal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stockloom.operators.ordering import quantiles
from stockloom.operators.relational import hash_sample
from stockloom.sources.io import write_parquet

KEY = ["outlet_id", "item_code", "year_month"]
CORRELATION_LIMIT = 0.80
#: Numeric columns that route rows to models; never removed as correlated.
ROUTING = ["grid_cell"]


def attach(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the row key; columns of ``right`` that ``left`` has already are left out."""
    extra = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(*KEY, *extra), KEY, "left")


def active_rows(df: DataFrame, rate: str = "demand_event_rate_6m") -> DataFrame:
    return df.where(F.col(rate) > 0)


def rows_by_month(zero: DataFrame, rate: str = "demand_event_rate_6m") -> DataFrame:
    """Rows before and after the activity filter per month."""
    return zero.groupBy("year_month").agg(
        F.count("*").alias("rows_before"), F.count_if(F.col(rate) > 0).alias("rows_after"))


def training_matrix(base: DataFrame, zero: DataFrame, target: DataFrame, sku: DataFrame, seasonal: DataFrame) -> DataFrame:
    """base + zero-inflation + target on the row key, then the SKU and seasonal lookups."""
    wide = attach(attach(base, zero), target)
    return wide.join(sku, "item_code", "left").join(seasonal, ["item_code", "month_int"], "left")


def sample_entities(df: DataFrame, key: str = "outlet_id", n: int = 800) -> DataFrame:
    return hash_sample(df, key, n)


def candidate_features(df: DataFrame, excluded: list[str], max_null: float = 0.5) -> list[str]:
    """Numeric columns outside ``excluded`` with at most ``max_null`` nulls; one aggregation."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in set(excluded)]
    row = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in numbers]).first()
    return [c for c in numbers if row["_n"] and (row["_n"] - row[c]) / row["_n"] <= max_null]


def fill_with_medians(df: DataFrame, features: list[str]) -> DataFrame:
    """Exact median in place of NULL. Columns without a NULL need no median, so none is looked for."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in features]).first()
    gaps = [c for c in features if counts[c] < counts["_n"]]
    out = df.withColumns({c: F.col(c).cast("double") for c in features})
    if not gaps:
        return out
    out = out.crossJoin(F.broadcast(quantiles(df, gaps, [0.5])))
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}_p50")) for c in gaps}).drop(*[f"{c}_p50" for c in gaps])


def _products(columns: list[str]):
    """Sum of the outer products of the rows of a task, one row of k x k numbers."""

    def of(batches):
        total = np.zeros((len(columns), len(columns)))
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["products"])

    return of


def correlation_matrix(df: DataFrame, features: list[str]) -> tuple[list[str], np.ndarray]:
    """Pearson matrix over median-filled features; constant columns are left out.

    Only the k x k matrix comes to the driver.
    """
    filled = fill_with_medians(df.select(*features), features)
    moments = filled.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("spread")).alias(c) for c in features]).first()
    varying = [c for c in features if moments[c].spread]
    k = len(varying)
    centred = filled.select(*[(F.col(c) - F.lit(moments[c].mean)).alias(f"c{j}") for j, c in enumerate(varying)])
    products = centred.mapInArrow(_products(centred.columns), "products array<double>")
    sums = products.select(F.posexplode("products").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    cov = np.zeros(k * k)
    for r in sums:  # k x k
        cov[r["at"]] = r["x"]
    cov = cov.reshape(k, k)
    scale = np.sqrt(np.diag(cov))
    corr = cov / np.outer(scale, scale)
    np.fill_diagonal(corr, 1.0)
    return varying, corr


def correlation_frame(df: DataFrame, features: list[str]) -> DataFrame:
    """Long upper triangle (feature_a, feature_b, pearson_r) of :func:`correlation_matrix`."""
    return upper_triangle(df.sparkSession, *correlation_matrix(df, features))


def upper_triangle(spark: SparkSession, names: list[str], corr: np.ndarray) -> DataFrame:
    """Rows (feature_a, feature_b, pearson_r) of a matrix that is known already; at most k (k - 1) / 2."""
    rows = [(a, b, float(corr[x][y])) for x, a in enumerate(names) for y, b in enumerate(names) if x < y]
    return spark.createDataFrame(rows, "feature_a string, feature_b string, pearson_r double")


def correlated_pairs(pairs: DataFrame, limit: float = CORRELATION_LIMIT) -> DataFrame:
    return pairs.where(F.abs("pearson_r") >= limit)


def greedy_drop(features: list[str], corr: np.ndarray, limit: float = CORRELATION_LIMIT) -> tuple[list[str], list[str]]:
    """(kept, dropped): remove the feature in most violating pairs until none is left.

    Ties go to the larger sum of absolute correlations, then to the earlier feature.
    """
    strength = np.abs(np.asarray(corr, dtype=float))
    kept = list(range(len(features)))
    dropped = []
    while True:
        sub = strength[np.ix_(kept, kept)]
        violations = (sub >= limit).sum(axis=1) - (np.diag(sub) >= limit)
        if not violations.any():
            return [features[j] for j in kept], [features[j] for j in dropped]
        worst = max(range(len(kept)), key=lambda j: (violations[j], sub[j].sum(), -j))
        dropped.append(kept.pop(worst))


def strongest_partner(pairs: DataFrame, kept: list[str], dropped: list[str]) -> DataFrame:
    """For every dropped feature the retained feature it correlates with most."""
    both = pairs.select(F.col("feature_a").alias("dropped"), F.col("feature_b").alias("partner"), "pearson_r").unionByName(
        pairs.select(F.col("feature_b").alias("dropped"), F.col("feature_a").alias("partner"), "pearson_r"))
    fit = both.where(F.col("dropped").isin(dropped) & F.col("partner").isin(kept))
    best = fit.groupBy("dropped").agg(F.min_by(F.struct("partner", "pearson_r"), F.struct(-F.abs("pearson_r"), "partner")).alias("_b"))
    return best.select("dropped", "_b.partner", "_b.pearson_r")


def write_reduced(df: DataFrame, dropped: list[str], path: str, active: DataFrame | None = None, keep: list[str] = tuple(KEY)) -> DataFrame:
    """Write a table without the dropped columns, restricted to the active keys if given."""
    rows = df if active is None else df.join(active.select(*KEY), KEY, "left_semi")
    out = rows.drop(*[c for c in dropped if c in df.columns and c not in keep])
    write_parquet(out, path, "zstd")
    return df.sparkSession.read.parquet(path)
