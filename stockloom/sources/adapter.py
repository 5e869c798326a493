"""Supplied order tables -> invoice lines, product map and region map.

One order line is one invoice line: customer = outlet, nation = territory,
brand|type = SKU, supplier = route, order priority = payment term, and lines
flagged ``R`` are returns. Money is DECIMAL(18,4) so that sums do not depend on
how the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MONEY = "decimal(18,4)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sku(separator: str = "|"):
    return F.concat_ws(separator, "p_brand", "p_type")


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Invoice lines with one row per order line, unsigned quantity."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    parts = table(spark, folder, "part").select("p_partkey", sku().alias("item_code"))
    joined = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
    )
    net = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast(MONEY)
    returned = F.col("l_returnflag") == "R"
    return joined.select(
        F.col("o_orderdate").cast("date").alias("document_date"),
        F.col("l_orderkey").cast("string").alias("document_number"),
        F.col("o_custkey").cast("string").alias("outlet_id"),
        F.col("c_nationkey").cast("string").alias("territory_id"),
        F.when(returned, "return").otherwise("invoice").alias("document_type"),
        "item_code",
        F.col("l_suppkey").cast("string").alias("route_id"),
        F.col("o_orderpriority").alias("payment_term"),
        F.when(returned, -net).otherwise(net).cast(MONEY).alias("net_sales"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_discount").alias("discount"),
    )


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Processed invoice lines: returns carry a negative quantity."""
    lines = raw_lines(spark, folder)
    returned = F.col("document_type") == "return"
    return lines.withColumn("quantity", F.when(returned, -F.col("quantity")).otherwise(F.col("quantity")))


def product(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        sku().alias("item_code"),
        F.col("p_type").alias("product_category"),
        F.col("p_brand").alias("product_line"),
        F.col("p_brand").alias("brand"),
    ).distinct()


def region(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation")
    regions = table(spark, folder, "region")
    return nations.join(regions, nations.n_regionkey == regions.r_regionkey).select(
        F.col("n_nationkey").cast("string").alias("territory_id"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("district"),
        F.col("r_name").alias("province"),
    )


def base_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with month, product and region attributes."""
    from stockloom.operators.facts import attach_dimensions, with_month

    dated = with_month(sales(spark, folder))
    return attach_dimensions(dated, product(spark, folder), region(spark, folder))
