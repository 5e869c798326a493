"""Provinces, territories, regions and payment mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stockloom.functions.clean import ratio
from stockloom.functions.stats import f_p
from stockloom.operators.ordering import running_totals
from stockloom.operators.portfolio import chi_square, revenue, yearly_sales
from stockloom.operators.relational import ranked_share, share_in_group

HIGH_CR3 = 0.60


def ranked_revenue(territory: DataFrame, grain: str) -> DataFrame:
    """Revenue, share, cumulative share and rank per place."""
    return ranked_share(revenue(territory, grain), [grain], "gross_sales")


def top_share(ranked: DataFrame, k: int = 3, name: str = "cr3") -> DataFrame:
    """Revenue share of the ``k`` largest places."""
    out = ranked.agg(F.sum(F.when(F.col("rank") <= k, F.col("gross_sales"))).alias("_k"), F.sum("gross_sales").alias("_t"))
    value = ratio(F.col("_k"), F.col("_t"))
    return out.select(value.alias(name), (value > HIGH_CR3).alias("is_high"))


def gini(sums: DataFrame, key: str, value: str = "gross_sales") -> DataFrame:
    """Gini coefficient of ``value`` over ``key``, and the share of the top three."""
    placed = running_totals(sums, [F.col(value), F.col(key)], {"_pos": F.lit(1).cast("bigint")})
    n = placed.agg(F.count("*").alias("n"))
    big = placed.crossJoin(F.broadcast(n)).agg(
        F.max("n").alias("n"), F.sum(F.col("_pos") * F.col(value)).cast("double").alias("_w"), F.sum(value).cast("double").alias("_t"),
        F.sum(F.when(F.col("_pos") > F.col("n") - 3, F.col(value))).cast("double").alias("_top"))
    g = F.try_divide(2 * F.col("_w"), F.col("n") * F.col("_t")) - (F.col("n") + 1) / F.col("n")
    return big.select("n", g.alias("gini"), F.try_divide("_top", "_t").alias("cr3"))


def lorenz(sums: DataFrame, key: str, value: str = "gross_sales") -> DataFrame:
    """Cumulative revenue share against cumulative share of places, ascending."""
    placed = running_totals(sums, [F.col(value), F.col(key)], {"_pos": F.lit(1).cast("bigint"), "_run": F.col(value)})
    total = sums.agg(F.count("*").alias("_n"), F.sum(value).alias("_t"))
    return placed.crossJoin(F.broadcast(total)).select(
        key, value, ratio(F.col("_run"), F.col("_t")).alias("cumulative_share"),
        ratio(F.col("_pos"), F.col("_n")).alias("equality_line"))


def territory_years(territory: DataFrame) -> DataFrame:
    """Yearly sales per territory with last year's sales and growth; NULL after a year of zero."""
    yearly = yearly_sales(territory, ["territory_id", "region", "province"]).drop("gross_quantity")
    before = F.lag("gross_sales").over(Window.partitionBy("territory_id").orderBy("year"))
    out = yearly.withColumn("prev_year_sales", before)
    return out.withColumn("yoy_growth", ratio(F.col("gross_sales") - F.col("prev_year_sales"), F.col("prev_year_sales")))


def territory_growth(years: DataFrame) -> DataFrame:
    """Mean yearly growth and total sales per territory."""
    return years.groupBy("territory_id", "region", "province").agg(
        F.avg("yoy_growth").alias("yoy_growth"), F.sum("gross_sales").alias("gross_sales"))


def growth_extremes(growth: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` fastest and the ``k`` slowest territories."""
    known = growth.where("yoy_growth is not null")
    top = known.orderBy(F.desc("yoy_growth"), "territory_id").limit(k).withColumn("side", F.lit("top"))
    return top.unionByName(known.orderBy("yoy_growth", "territory_id").limit(k).withColumn("side", F.lit("bottom")))


def one_way_anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """F statistic, degrees of freedom and tail probability, from deviations around group means."""
    v = F.col(value).cast("double")
    groups = df.groupBy(group).agg(F.count(v).alias("_n"), F.avg(v).alias("_m"), F.var_pop(v).alias("_v"))
    grand = groups.agg(F.sum("_n").alias("_t"), (F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_g"))
    gap = F.col("_m") - F.col("_g")
    sums = groups.crossJoin(F.broadcast(grand)).agg(
        F.sum(F.col("_n") * gap * gap).alias("_between"), F.sum(F.col("_n") * F.col("_v")).alias("_within"),
        (F.count("*") - 1).alias("df_between"), (F.max("_t") - F.count("*")).alias("df_within"))
    stat = F.try_divide(
        F.try_divide(F.col("_between"), F.col("df_between")), F.try_divide(F.col("_within"), F.col("df_within")))
    out = sums.select(stat.alias("f_stat"), "df_between", "df_within")
    return out.withColumn("p_value", f_p("f_stat", F.col("df_between").cast("double"), F.col("df_within").cast("double")))


def payment_by_region(base: DataFrame) -> DataFrame:
    """Net sales, quantity and line count per region and payment term."""
    return base.where("region is not null and payment_term is not null").groupBy("region", "payment_term").agg(
        F.sum("net_sales").alias("net_sales"), F.sum("quantity").alias("quantity"), F.count("document_number").alias("n_invoices"))


def payment_mix(payment: DataFrame) -> DataFrame:
    """Percent of a region's lines per payment term."""
    return share_in_group(payment, "n_invoices", ["region"], "_s").select(
        "region", "payment_term", (F.col("_s") * 100).alias("pct"))


def payment_independence(payment: DataFrame) -> DataFrame:
    return chi_square(payment, "region", "payment_term", "n_invoices")


