"""Frames the registered queries start from, all derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockloom.operators import classify, facts
from stockloom.plans.sqlparts import CASH
from stockloom.sources import adapter
from stockloom.sources.adapter import base_sales, product, region, sales  # noqa: F401
from stockloom.sources.staging import stage


def bounds(spark, folder) -> DataFrame:
    return facts.month_bounds(facts.with_month(adapter.table(spark, folder, "orders").join(
        adapter.table(spark, folder, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi"
    ).select(F.col("o_orderdate").cast("date").alias("document_date"))))


def spine(spark, folder) -> DataFrame:
    month = F.explode(F.expr("sequence(first_month, last_month, interval 1 month)"))
    return bounds(spark, folder).select(month.alias("_m")).select(F.date_format("_m", "yyyy-MM").alias("year_month"))


def sparse_demand(spark, folder) -> DataFrame:
    """Non-zero outlet x SKU months; sums over it equal sums over the full grid."""
    return facts.pair_months(base_sales(spark, folder))


def full_demand(spark, folder, carry: DataFrame | None = None) -> DataFrame:
    """The zero-filled grid; ``carry`` (one row per outlet) is joined before it is filled and limits it to its outlets."""
    if carry is None:
        return facts.outlet_sku_monthly_demand(base_sales(spark, folder), bounds(spark, folder))
    kept = sparse_demand(spark, folder).join(carry, "outlet_id")
    return facts.fill_months(kept, facts.PAIR, bounds(spark, folder), {c: 0 for c in facts.DEMAND})


def activity(spark, folder) -> DataFrame:
    return facts.outlet_monthly_activity(base_sales(spark, folder))


def outlets(spark, folder) -> DataFrame:
    return facts.outlet_features(stage(activity(spark, folder)), cash=CASH)


def territories(spark, folder) -> DataFrame:
    return facts.monthly_territory_demand(
        sparse_demand(spark, folder), region(spark, folder), spine(spark, folder)
    )


def national_sku(spark, folder) -> DataFrame:
    return facts.national_sku_demand(sparse_demand(spark, folder), bounds(spark, folder))


def sku_stats(spark, folder) -> DataFrame:
    national = facts.national_sku_demand(sparse_demand(spark, folder))
    return classify.activity_and_cv(national, classify.month_count(bounds(spark, folder)))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, decimals as doubles, counts as bigint."""
    cells = []
    for f in df.schema:
        kind, c = f.dataType.typeName(), F.col(f.name)
        if kind == "decimal":
            cells.append(c.cast("double").alias(f.name))
        elif kind in ("double", "float"):
            cells.append(F.round(c.cast("double"), 6).alias(f.name))
        elif kind in ("integer", "short", "byte"):
            cells.append(c.cast("bigint").alias(f.name))
        else:
            cells.append(c)
    return df.select(*cells)


def sparse_full_years(spark, folder) -> DataFrame:
    """Demand per SKU and month with its attributes, empty months of a SKU included.

    Yearly shares and growth need the years in which a SKU sold nothing.
    """
    dims = ["item_code", *facts.GOODS]
    summed = sparse_demand(spark, folder).groupBy(*dims, "year_month").agg(
        F.sum("gross_sales").alias("gross_sales"), F.sum("gross_quantity").alias("gross_quantity"))
    return facts.fill_months(summed, dims, bounds(spark, folder), {"gross_sales": 0, "gross_quantity": 0})
