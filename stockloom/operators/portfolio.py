"""Product concentration, growth, mix and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockloom.functions.clean import ratio, year_of
from stockloom.functions.stats import chi2_p
from stockloom.operators.classify import demand_class, month_count
from stockloom.operators.ordering import quantiles
from stockloom.operators.relational import ranked_share, share_in_group, share_of_total

CORE, GROWTH = 0.80, 0.95
HIGH_HHI = 0.25
EPS = 1e-9


def revenue(demand: DataFrame, grain: str, extra: list[str] | None = None) -> DataFrame:
    """Gross sales and quantity per value of ``grain``; ``extra`` columns must depend on it."""
    return demand.groupBy(grain, *list(extra or [])).agg(
        F.sum("gross_sales").alias("gross_sales"), F.sum("gross_quantity").alias("gross_quantity"))


def pareto(sums: DataFrame, grain: str) -> DataFrame:
    """Share, cumulative share, rank and segment by descending gross sales."""
    ranked = ranked_share(sums, [grain], "gross_sales")
    c = F.col("cumulative_share")
    return ranked.withColumn(
        "pareto_segment", F.when(c <= CORE, "Core").when(c <= GROWTH, "Growth").otherwise("Long Tail"))


def pareto_summary(ranked: DataFrame) -> DataFrame:
    sums = ranked.groupBy("pareto_segment").agg(F.count("*").alias("n_skus"), F.sum("gross_sales").alias("total_sales"))
    return share_of_total(sums, "total_sales", "_s").withColumn("pct_revenue", F.round(F.col("_s") * 100, 2)).drop("_s")


def hhi(sums: DataFrame, grain: str) -> DataFrame:
    """Herfindahl-Hirschman index of gross sales over ``grain``."""
    x = F.col("gross_sales").cast("double")
    out = sums.agg(F.sum(x * x).alias("_sq"), F.sum("gross_sales").cast("double").alias("_t"))
    value = F.try_divide(F.col("_sq"), F.col("_t") * F.col("_t"))
    return out.select(F.lit(grain).alias("grain"), value.alias("hhi"), (value > HIGH_HHI).alias("is_high"))


def yearly_sales(demand: DataFrame, keys: list[str]) -> DataFrame:
    """Month sums rolled up to years."""
    return demand.groupBy(*keys, year_of(F.col("year_month")).alias("year")).agg(
        F.sum("gross_sales").alias("gross_sales"), F.sum("gross_quantity").alias("gross_quantity"))


def cagr(demand: DataFrame, grain: str = "product_line") -> DataFrame:
    """Growth per year from the first to the last year; 0 without a positive start or a second year."""
    sums = yearly_sales(demand, [grain]).groupBy(grain).agg(
        F.min_by("gross_sales", "year").cast("double").alias("_first"),
        F.max_by("gross_sales", "year").cast("double").alias("_last"),
        (F.max("year") - F.min("year")).alias("n_years"), F.sum("gross_sales").alias("total_sales"))
    usable = (F.col("_first") > 0) & (F.col("n_years") > 0)
    growth = F.pow(F.try_divide(F.col("_last"), F.col("_first")), F.try_divide(F.lit(1.0), F.col("n_years"))) - 1
    out = sums.withColumn("cagr", F.when(usable, growth).otherwise(0.0))
    return share_of_total(out, "total_sales", "revenue_share").drop("_first", "_last")


def quadrants(growth: DataFrame) -> DataFrame:
    """Two by two on the median growth and the median share."""
    mid = quantiles(growth, ["cagr", "revenue_share"], [0.5])
    fast, large = F.col("cagr") >= F.col("cagr_p50"), F.col("revenue_share") >= F.col("revenue_share_p50")
    name = (
        F.when(fast & large, "Protect & Invest").when(large, "Defend").when(fast, "Nurture").otherwise("Review/Exit"))
    return growth.crossJoin(F.broadcast(mid)).withColumn("quadrant", name).drop("cagr_p50", "revenue_share_p50")


def mix_by_year(demand: DataFrame, grain: str) -> DataFrame:
    """Quantity share of each value within its year."""
    return share_in_group(yearly_sales(demand, [grain]), "gross_quantity", ["year"], "share")


def return_risk(demand: DataFrame, grain: str) -> DataFrame:
    """Returned share of shipped quantity, z-score over the group rates and flag above 2."""
    sums = demand.groupBy(grain).agg(*[
        F.sum(c).alias(c) for c in ("return_quantity", "gross_quantity", "n_returns", "n_invoices")])
    both = (F.col("return_quantity") + F.col("gross_quantity")).cast("double")
    rates = sums.withColumn("return_rate", F.col("return_quantity") / (both + EPS))
    spread = rates.agg(F.avg("return_rate").alias("_m"), F.stddev_samp("return_rate").alias("_s"))
    z = (F.col("return_rate") - F.col("_m")) / (F.col("_s") + EPS)
    return rates.crossJoin(F.broadcast(spread)).withColumn("z_score", z).withColumn("flag", z > 2).drop("_m", "_s")


def chi_square(cells: DataFrame, row: str, column: str, n: str) -> DataFrame:
    """Independence test of a contingency table in long form (missing cells are 0).

    One row: statistic, degrees of freedom, tail probability. With one degree of
    freedom every deviation is shrunk by up to one half (continuity correction).
    """
    rows = cells.groupBy(row).agg(F.sum(n).alias("_r")).where("_r > 0")
    cols = cells.groupBy(column).agg(F.sum(n).alias("_c")).where("_c > 0")
    size = rows.agg(F.count("*").alias("_nr"), F.sum("_r").alias("_t")).crossJoin(cols.agg(F.count("*").alias("_nc")))
    # sum over all cells of (o - e)^2 / e = sum over present cells of o^2 / e - total,
    # so the empty cells never have to be built
    parts = cells.join(rows, row).join(cols, column).crossJoin(F.broadcast(size))
    e = F.col("_r").cast("double") * F.col("_c") / F.col("_t")
    o = F.col(n).cast("double")
    dof = (F.col("_nr") - 1) * (F.col("_nc") - 1)
    # a 2 x 2 table is complete in four cells; the absent ones are rebuilt from the margins
    per_cell = parts.groupBy("_nr", "_nc", "_t").agg(
        F.sum(F.try_divide(o * o, e)).alias("_q"), F.max(F.abs(o - e)).alias("_gap"), F.sum(F.try_divide(F.lit(1.0), e)).alias("_inv"))
    margins = _two_by_two(rows, cols, size)
    shrunk = F.col("_gap") - F.least(F.lit(0.5), F.col("_gap"))
    stat = F.when(dof == 1, shrunk * shrunk * F.coalesce(F.col("_inv4"), F.col("_inv"))).otherwise(F.col("_q") - F.col("_t"))
    out = per_cell.crossJoin(margins).select(stat.alias("chi2"), dof.cast("bigint").alias("dof"))
    return out.withColumn("p_value", chi2_p(F.col("chi2"), F.col("dof").cast("double")))


def _two_by_two(rows: DataFrame, cols: DataFrame, size: DataFrame) -> DataFrame:
    """Sum of 1/expected over the four cells of a 2 x 2 table: (Σ1/r)(Σ1/c)·total."""
    r = rows.agg(F.sum(F.try_divide(F.lit(1.0), F.col("_r"))).alias("_ir"))
    c = cols.agg(F.sum(F.try_divide(F.lit(1.0), F.col("_c"))).alias("_ic"))
    t = size.select(F.col("_t").cast("double").alias("_tt"))
    return r.crossJoin(c).crossJoin(t).select((F.col("_ir") * F.col("_ic") * F.col("_tt")).alias("_inv4"))


def return_independence(demand: DataFrame, grain: str = "product_category") -> DataFrame:
    """Are returns independent of the category? Invoice and return lines by category."""
    sums = demand.groupBy(grain).agg(F.sum("n_invoices").alias("n_invoices"), F.sum("n_returns").alias("n_returns"))
    cells = sums.select(grain, F.expr("stack(2, 'invoice', n_invoices, 'return', n_returns) as (kind, n)"))
    return chi_square(cells, grain, "kind", "n")


def sku_continuity(demand: DataFrame, bounds: DataFrame, dims: list[str] = ("product_category", "product_line", "brand")) -> DataFrame:
    """Activity rate, CV of active months and class per SKU; a single active month has CV 0."""
    q = F.col("gross_quantity")
    monthly = demand.groupBy("item_code", *dims, "year_month").agg(F.sum(q).alias("gross_quantity"))
    sold = F.when(q > 0, q)
    stats = monthly.groupBy("item_code", *dims).agg(
        F.count(sold).alias("active_months"), F.avg(sold).alias("_mean"), F.stddev_samp(sold).alias("_std"),
        F.sum(q).alias("total_quantity"))
    cv = F.coalesce(F.try_divide(F.col("_std"), F.col("_mean")), F.lit(0.0))
    out = stats.crossJoin(F.broadcast(month_count(bounds))).withColumns(
        {"activity_rate": ratio(F.col("active_months"), F.col("total_months")), "cv": cv})
    labelled = out.withColumn("demand_class", demand_class(F.col("activity_rate"), F.col("cv")))
    return labelled.withColumnRenamed("total_months", "n_months_available").drop("_mean", "_std")


def continuity_summary(continuity: DataFrame) -> DataFrame:
    sums = continuity.groupBy("demand_class").agg(
        F.count("*").alias("n_skus"), F.sum("total_quantity").alias("total_quantity"),
        F.avg("cv").alias("mean_cv"), F.avg("activity_rate").alias("mean_activity"))
    shares = share_of_total(share_of_total(sums, "n_skus", "_n"), "total_quantity", "_v")
    return shares.withColumns({
        "pct_of_skus": F.round(F.col("_n") * 100, 1), "pct_of_volume": F.round(F.col("_v") * 100, 1)}).drop("_n", "_v")


def class_pivot(continuity: DataFrame, grain: str = "product_category") -> DataFrame:
    from stockloom.operators.relational import contingency

    return contingency(continuity, grain, "demand_class", ["Continuous", "Intermittent", "Lumpy"], F.count(F.lit(1)))
