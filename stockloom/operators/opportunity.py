"""Territory share, routes, buffers, peer tiers and sales potential."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from stockloom.functions.clean import ratio
from stockloom.operators.ordering import average_ranks, global_rank, quantiles_long

PROFILE = ["total_net_sales", "total_quantity", "loyalty_ratio", "avg_net_sales_per_txn", "n_unique_skus", "return_rate", "recency_months"]


def active_per_territory(demand: DataFrame) -> DataFrame:
    """Distinct outlets and SKUs with an invoice per territory and month."""
    return demand.where("n_invoices > 0").groupBy("territory_id", "year_month").agg(
        F.countDistinct("outlet_id").alias("n_active_outlets"), F.countDistinct("item_code").alias("n_active_skus"))


def share_of_territory(demand: DataFrame) -> DataFrame:
    """Outlet x SKU quantity over the territory's quantity of the month.

    Totals come from a pre-aggregated join: a territory with a third of all
    outlets is not gathered in one window task.
    """
    totals = demand.groupBy("territory_id", "year_month").agg(F.sum("net_quantity").alias("terr_net_quantity"))
    joined = demand.select("outlet_id", "item_code", "territory_id", "year_month", "net_quantity").join(
        totals, ["territory_id", "year_month"])
    return joined.withColumn("outlet_share_of_territory", F.col("net_quantity") / (F.col("terr_net_quantity") + 1e-8))


def route_density(base: DataFrame) -> DataFrame:
    """Outlets, quantity and revenue per outlet of every route."""
    sums = base.groupBy("route_id").agg(
        F.countDistinct("outlet_id").alias("n_outlets"), F.sum("quantity").alias("quantity"), F.sum("net_sales").alias("net_sales"))
    return sums.withColumn("sales_per_outlet", ratio(F.col("net_sales"), F.col("n_outlets")))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation from tie-averaged ranks of the distinct values."""
    one = F.count(F.lit(1))
    rx = average_ranks(df, x, {"_c": one}).select(x, F.col("avg_rank").alias("_rx"))
    ry = average_ranks(df, y, {"_c": one}).select(y, F.col("avg_rank").alias("_ry"))
    ranked = df.select(x, y).join(rx, x).join(ry, y)
    m = ranked.agg(
        F.count("*").alias("n"), F.covar_pop("_rx", "_ry").alias("_c"), F.stddev_pop("_rx").alias("_a"), F.stddev_pop("_ry").alias("_b"))
    return m.select("n", F.try_divide(F.col("_c"), F.col("_a") * F.col("_b")).alias("rho"))


def safety_stock(patterns: DataFrame, z: float = 1.65, lead_months: float = 1.0) -> DataFrame:
    """z x deviation x square root of the lead time per SKU (deviation = CV x mean active quantity)."""
    sigma = F.col("cv") * F.col("mean_active_qty")
    return patterns.select("item_code", sigma.alias("sigma"), (sigma * (z * math.sqrt(lead_months))).alias("safety_stock"))


def tiers(outlets: DataFrame, group: str = "cluster_definition", top: float = 0.30, bottom: float = 0.10) -> DataFrame:
    """Top, Middle and Bottom by descending sales within each group."""
    ranked = global_rank(outlets, [(-F.col("total_net_sales")).alias("_neg"), F.col("outlet_id")], "tier_rank", [group])
    sizes = outlets.groupBy(group).agg(F.count("*").alias("_n"))
    joined = ranked.join(sizes, group)
    pos = F.coalesce(ratio(F.col("tier_rank") - 1, F.col("_n") - 1), F.lit(0.0))
    name = F.when(pos <= top, "Top").when(pos <= 1 - bottom, "Middle").otherwise("Bottom")
    return joined.withColumn("tier", name).drop("_n")


def tier_profile(tiered: DataFrame, group: str = "cluster_definition", features: list[str] = PROFILE) -> DataFrame:
    """Mean and median of each feature per group and tier, long form."""
    from stockloom.operators.relational import column_stats

    keys = [group, "tier"]
    means = column_stats(tiered, features, {"n": F.count, "mean": F.avg}, keys)
    mid = quantiles_long(tiered, features, [0.5], keys).select(*keys, "feature", F.col("quantile").alias("median"))
    return means.join(mid, [*keys, "feature"])


def ceilings(tiered: DataFrame, group: str = "cluster_definition") -> DataFrame:
    """Median sales of the top tier per group."""
    top = quantiles_long(tiered.where("tier = 'Top'"), ["total_net_sales"], [0.5], [group])
    return top.select(group, F.col("quantile").alias("ceiling"))


def uplift(tiered: DataFrame, group: str = "cluster_definition") -> DataFrame:
    """Distance of every outlet below the top tier to its group's ceiling."""
    sales = F.col("total_net_sales").cast("double")
    rows = tiered.where("tier <> 'Top'").join(ceilings(tiered, group), group)
    gap = F.col("ceiling") - sales
    return rows.select("outlet_id", group, "tier", sales.alias("total_net_sales"), "ceiling", gap.alias("uplift"), (ratio(gap, sales) * 100).alias("gap_pct"))


def uplift_totals(gaps: DataFrame, group: str = "cluster_definition") -> DataFrame:
    return gaps.groupBy(group).agg(F.count("*").alias("n_outlets"), F.sum("uplift").alias("total_uplift"))


def cluster_and_region_gap(outlets: DataFrame) -> DataFrame:
    """Gap to the cluster ceiling beside the gap to the region ceiling."""
    own = uplift(tiers(outlets)).select("outlet_id", F.col("uplift").alias("cluster_gap"))
    region = ceilings(tiers(outlets, "region"), "region")
    sales = F.col("total_net_sales").cast("double")
    place = outlets.join(region, "region").select("outlet_id", (F.col("ceiling") - sales).alias("region_gap"))
    signal = F.when(F.col("cluster_gap") < F.col("region_gap"), "below peers").otherwise("region ceiling")
    return own.join(place, "outlet_id").withColumn("signal", signal)


def mann_whitney(df: DataFrame, value: str, side: str, by: list[str]) -> DataFrame:
    """U of the rows with ``side`` true against the others, per group, and its normal score."""
    ranked = average_ranks(df, value, {"a": F.count_if(F.col(side))}, by)
    t = F.col("n_tied").cast("double")
    s = ranked.groupBy(*by).agg(
        F.sum("a").alias("n1"), F.sum("n_tied").alias("_n"), F.sum(F.col("avg_rank") * F.col("a")).alias("_r"),
        F.sum(t * t * t - t).alias("_ties"))
    n1, n = F.col("n1"), F.col("_n")
    n2 = n - n1
    u = F.col("_r") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / F.lit(12.0) * ((n + 1) - F.try_divide(F.col("_ties"), n.cast("double") * (n - 1))))
    return s.select(*by, "n1", n2.alias("n2"), u.alias("u"), F.try_divide(u - n1 * n2 / 2, spread).alias("z"))


def cluster_statistics(outlets: DataFrame, features: list[str], group: str = "cluster_definition") -> DataFrame:
    """Mean, median and deviation of each feature per cluster, long form."""
    from stockloom.operators.relational import describe

    return describe(outlets, features, [group]).select(group, "feature", "n", "mean", F.col("p50").alias("median"), "std")


def cluster_independence(outlets: DataFrame, group: str = "cluster_definition", place: str = "region") -> DataFrame:
    from stockloom.operators.portfolio import chi_square

    cells = outlets.groupBy(group, place).agg(F.count("*").alias("n"))
    return chi_square(cells, group, place, "n")
