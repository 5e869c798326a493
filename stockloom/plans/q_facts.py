"""Fact tables, audits and demand classes."""

from pyspark.sql import functions as F

from stockloom.operators import classify, facts
from stockloom.plans import inputs as i
from stockloom.plans.registry import query
from stockloom.plans.sqlparts import ACTIVITY, BASE, GRID, LINES, OUTLETS, TERRITORY
from stockloom.sources import adapter

D = facts.DEMAND

LINE_LIST = """document_number, strftime(document_date, '%Y-%m-%d') AS document_date, outlet_id, territory_id, document_type,
 item_code, route_id, payment_term, net_sales::DOUBLE AS net_sales, quantity, discount"""

RAW_SALES = r"""
 regexp_replace(lower(trim(strftime(o_orderdate, '%Y-%m-%d'))), '[\s\-]+', '_', 'g') AS document_date,
 CAST(l_orderkey AS VARCHAR) AS document_number, CAST(o_custkey AS VARCHAR) AS outlet_id,
 CAST(c_nationkey AS VARCHAR) AS territory_id,
 CASE WHEN l_returnflag = 'R' THEN 'return' ELSE 'invoice' END AS document_type,
 regexp_replace(regexp_replace(lower(p_brand || ' ' || p_type), '[\s\-]+', '_', 'g'), '[^\w]', '', 'g') AS item_code,
 CAST(l_suppkey AS VARCHAR) AS route_id,
 regexp_replace(regexp_replace(lower(o_orderpriority), '[\s\-]+', '_', 'g'), '[^\w]', '', 'g') AS payment_term,
 l_extendedprice AS net_sales, CAST(l_quantity AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS quantity,
 l_discount AS discount"""


def delivered_lines(spark, d):
    """Lines under the headers of the delivered invoice file, values not yet cleaned."""
    lines = adapter.table(spark, d, "lineitem")
    orders = adapter.table(spark, d, "orders")
    customers = adapter.table(spark, d, "customer")
    parts = adapter.table(spark, d, "part")
    j = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey).join(parts, lines.l_partkey == parts.p_partkey)
    )
    return j.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("documentDate"),
        F.col("l_orderkey").cast("string").alias("DocumnetNumber"),
        F.col("o_custkey").cast("string").alias("OutletID"),
        F.col("c_nationkey").cast("bigint").alias("TerritoryID"),
        F.when(F.col("l_returnflag") == "R", "Return").otherwise(" Invoice ").alias("DocumentType"),
        F.concat_ws(" ", "p_brand", "p_type").alias("ItemCode"),
        F.col("l_suppkey").cast("string").alias("RouteID"),
        F.col("o_orderpriority").alias("PaymentTerm"),
        F.lit("Yes").alias("IsDirectDistributor"),
        F.col("l_extendedprice").alias("NetSales"),
        F.col("l_quantity").cast("bigint").alias("Quantity"),
        F.col("l_discount").alias("Discount"),
    )


@query("tb1_process_sales", f"SELECT {RAW_SALES} FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
       "JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey")
def _(spark, d):
    return facts.process_sales(delivered_lines(spark, d))


@query("tb1_process_product", r"""
SELECT regexp_replace(regexp_replace(lower(p_brand || ' ' || p_type), '[\s\-]+', '_', 'g'), '[^\w]', '', 'g') AS item_code,
 lower(p_type) AS product_category, replace(lower(p_brand), '#', '') AS product_line,
 replace(lower(p_name), ' ', '_') AS brand, p_partkey AS part_number FROM part""")
def _(spark, d):
    raw = adapter.table(spark, d, "part").select(
        F.concat_ws(" ", "p_brand", "p_type").alias("Item Code"), F.col("p_type").alias("Product Category "),
        F.col("p_brand").alias("Product line "), F.col("p_name").alias("Brand "), F.col("p_partkey").alias("Part-Number"),
    )
    return facts.process_dimension(raw)


@query("tb1_process_region", """
SELECT CAST(n_nationkey AS VARCHAR) AS territory_id, replace(lower(r_name), ' ', '_') AS region,
 lower(n_name) AS district, replace(lower(r_name), ' ', '_') AS province FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(spark, d):
    n, r = adapter.table(spark, d, "nation"), adapter.table(spark, d, "region")
    raw = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("TerritoryID"), F.col("r_name").alias("Region"),
        F.col("n_name").alias("District "), F.col("r_name").alias("Province"),
    )
    return facts.process_dimension(raw, ["territory_id"])


@query("tb2_base_sales_enriched", f"""WITH {BASE} SELECT {LINE_LIST}, year_month, product_category, product_line, brand,
 region, district, province FROM base""")
def _(spark, d):
    out = i.base_sales(spark, d)
    return i.tidy(out.withColumn("document_date", F.col("document_date").cast("string")))


DEMAND_SUMS = ", ".join(
    f"CAST(sum({c}) AS {'DOUBLE' if 'sales' in c else 'BIGINT'}) AS {c}" for c in D
)


@query("tb3_outlet_sku_monthly_demand", f"""WITH {GRID}
SELECT item_code, year_month, count(*) AS n_rows,
 count(*) FILTER (WHERE net_quantity = 0 AND n_invoices = 0 AND n_returns = 0) AS n_empty, {DEMAND_SUMS},
 CAST(sum(net_quantity * net_quantity) AS BIGINT) AS sum_sq_quantity, CAST(sum(CAST(territory_id AS BIGINT)) AS BIGINT) AS sum_territory,
 count(region) AS n_region, count(district) AS n_district, product_category, product_line, brand
FROM grid GROUP BY ALL""")
def _(spark, d):
    """The whole zero-filled grid is built; it is reported per SKU and month."""
    grid = i.full_demand(spark, d)
    empty = (F.col("net_quantity") == 0) & (F.col("n_invoices") == 0) & (F.col("n_returns") == 0)
    return i.tidy(grid.groupBy("item_code", "year_month", "product_category", "product_line", "brand").agg(
        F.count("*").alias("n_rows"),
        F.count_if(empty).alias("n_empty"), *[F.sum(c).alias(c) for c in D],
        F.sum(F.col("net_quantity") * F.col("net_quantity")).alias("sum_sq_quantity"),
        F.sum(F.col("territory_id").cast("bigint")).alias("sum_territory"),
        F.count("region").alias("n_region"), F.count("district").alias("n_district"),
    ))


@query("tb3_active_months", f"""WITH {GRID}
SELECT outlet_id, item_code, year_month, net_quantity, net_sales::DOUBLE AS net_sales, gross_quantity,
 gross_sales::DOUBLE AS gross_sales, return_quantity, return_sales::DOUBLE AS return_sales, n_invoices, n_returns,
 territory_id, region, district, province, product_category, product_line, brand
FROM grid WHERE n_invoices > 0 OR n_returns > 0""")
def _(spark, d):
    return i.tidy(i.sparse_demand(spark, d))


@query("tb4_outlet_monthly_activity", f"""WITH {ACTIVITY}
SELECT outlet_id, year_month, n_invoices, gross_quantity, gross_sales::DOUBLE AS gross_sales, n_returns, return_quantity,
 return_sales::DOUBLE AS return_sales, n_unique_skus, n_unique_categories, primary_payment_term, territory_id, region,
 district, province FROM activity""")
def _(spark, d):
    return i.tidy(i.activity(spark, d))


@query("tb5_monthly_territory_demand", f"""WITH {TERRITORY}
SELECT territory_id, year_month, net_quantity, net_sales::DOUBLE AS net_sales, gross_quantity, gross_sales::DOUBLE AS gross_sales,
 return_quantity, return_sales::DOUBLE AS return_sales, n_unique_skus, n_distinct_skus, region, district, province FROM territory""")
def _(spark, d):
    return i.tidy(i.territories(spark, d))


OUTLET_ROUND = """outlet_id, total_net_sales::DOUBLE AS total_net_sales, total_quantity, active_months,
 round(loyalty_ratio, 6) AS loyalty_ratio, round(avg_txn_per_active_month, 6) AS avg_txn_per_active_month,
 round(avg_net_sales_per_txn, 6) AS avg_net_sales_per_txn, round(avg_qty_per_txn, 6) AS avg_qty_per_txn,
 n_unique_skus, n_unique_categories, round(return_rate, 6) AS return_rate, recency_months,
 round(pct_cash_txn, 6) AS pct_cash_txn, round(momentum, 6) AS momentum, is_active, territory_id, region, province"""


@query("tb6_outlet_features", f"WITH {OUTLETS} SELECT {OUTLET_ROUND} FROM outlets")
def _(spark, d):
    return i.tidy(i.outlets(spark, d))


NATIONAL_SUMS = ", ".join(
    f"CAST(sum({c}) AS {'DOUBLE' if 'sales' in c else 'BIGINT'}) AS {c}" for c in D[:6]
)


@query("tb7_national_sku_demand", f"WITH {GRID} SELECT item_code, year_month, {NATIONAL_SUMS} FROM grid GROUP BY ALL")
def _(spark, d):
    return i.tidy(i.national_sku(spark, d))


@query("tb8_national_monthly_series", f"""WITH {GRID} SELECT year_month, CAST(sum(net_quantity) AS BIGINT) AS net_quantity,
 CAST(sum(net_sales) AS DOUBLE) AS net_sales, CAST(sum(gross_quantity) AS BIGINT) AS gross_quantity,
 CAST(sum(return_quantity) AS BIGINT) AS return_quantity FROM grid GROUP BY ALL""")
def _(spark, d):
    return i.tidy(facts.monthly_series(i.sparse_demand(spark, d), bounds=i.bounds(spark, d)))


def _audit_sql(name, key, source):
    return (f"SELECT '{name}' AS table_name, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (WHERE n > 1) AS repeated_keys, "
            f"CAST(sum(n - 1) AS BIGINT) AS surplus_rows FROM (SELECT count(*) AS n FROM {source} GROUP BY {key})")


@query("tb9_key_audit", f"""WITH {TERRITORY},
outlet_months AS (SELECT outlet_id, year_month FROM outlet_keys CROSS JOIN spine),
outlet_keys AS (SELECT DISTINCT outlet_id FROM base)
{_audit_sql('base_sales_enriched', 'document_number, item_code', 'base')} UNION ALL
{_audit_sql('outlet_sku_monthly_demand', 'outlet_id, item_code, year_month', 'grid')} UNION ALL
{_audit_sql('outlet_monthly_activity', 'outlet_id, year_month', 'outlet_months')} UNION ALL
{_audit_sql('monthly_territory_demand', 'territory_id, year_month', 'territory')}""".replace(
    "outlet_months AS (SELECT outlet_id, year_month FROM outlet_keys CROSS JOIN spine),\noutlet_keys AS (SELECT DISTINCT outlet_id FROM base)",
    "outlet_keys AS (SELECT DISTINCT outlet_id FROM base),\noutlet_months AS (SELECT outlet_id, year_month FROM outlet_keys CROSS JOIN spine)"))
def _(spark, d):
    parts = [
        facts.key_audit(i.base_sales(spark, d), ["document_number", "item_code"], "base_sales_enriched"),
        facts.key_audit(i.full_demand(spark, d), [*facts.PAIR, "year_month"], "outlet_sku_monthly_demand"),
        facts.key_audit(i.activity(spark, d), ["outlet_id", "year_month"], "outlet_monthly_activity"),
        facts.key_audit(i.territories(spark, d), ["territory_id", "year_month"], "monthly_territory_demand"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ACTIVITY_COLUMNS = ["outlet_id", "year_month", "n_invoices", "gross_quantity", "gross_sales", "primary_payment_term", "region"]


@query("tb9_null_audit", f"WITH {ACTIVITY} " + " UNION ALL ".join(
    f"SELECT 'outlet_monthly_activity' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"count(*) FILTER (WHERE {c} IS NULL) / count(*)::DOUBLE AS null_share FROM activity" for c in ACTIVITY_COLUMNS))
def _(spark, d):
    return facts.null_audit(i.activity(spark, d).select(*ACTIVITY_COLUMNS), "outlet_monthly_activity")


# -- outlet feature columns, one query per rule -------------------------------

def _outlet_columns(name, columns):
    picked = ", ".join(
        c if c in ("outlet_id", "is_active", "territory_id", "region", "province") else
        f"round({c}::DOUBLE, 6) AS {c}" if c in ROUNDED else c for c in columns
    )

    @query(name, f"WITH {OUTLETS} SELECT {picked} FROM outlets")
    def _(spark, d):
        return i.tidy(i.outlets(spark, d).select(*columns))


ROUNDED = {"total_net_sales", "loyalty_ratio", "avg_txn_per_active_month", "avg_net_sales_per_txn",
           "avg_qty_per_txn", "return_rate", "pct_cash_txn", "momentum"}
_outlet_columns("of1_totals", ["outlet_id", "total_net_sales", "total_quantity"])
_outlet_columns("of2_active_months", ["outlet_id", "active_months", "loyalty_ratio", "is_active"])
_outlet_columns("of3_txn_per_active_month", ["outlet_id", "avg_txn_per_active_month"])
_outlet_columns("of4_value_per_txn", ["outlet_id", "avg_net_sales_per_txn", "avg_qty_per_txn"])
_outlet_columns("of5_unique_counts", ["outlet_id", "n_unique_skus", "n_unique_categories"])
_outlet_columns("of6_return_rate", ["outlet_id", "return_rate"])
_outlet_columns("of7_recency_constant", ["outlet_id", "recency_months"])
_outlet_columns("of8_pct_cash", ["outlet_id", "pct_cash_txn"])
_outlet_columns("of9_momentum", ["outlet_id", "momentum"])
_outlet_columns("of10_outlet_place", ["outlet_id", "territory_id", "region", "province"])


# -- demand classes -----------------------------------------------------------

STATS = f"""{GRID},
national AS (SELECT item_code, year_month, sum(gross_quantity) AS gross_quantity, sum(gross_sales) AS gross_sales,
  sum(net_sales) AS net_sales, sum(return_quantity) AS return_quantity FROM grid GROUP BY ALL),
raw_stats AS (SELECT item_code, count(*) FILTER (WHERE gross_quantity > 0) AS n_active_months,
  avg(gross_quantity) FILTER (WHERE gross_quantity > 0) AS mean_nonzero_demand,
  stddev_samp(gross_quantity) FILTER (WHERE gross_quantity > 0) AS std_nonzero_demand,
  CAST(sum(gross_quantity) AS BIGINT) AS total_quantity, sum(gross_sales)::DOUBLE AS total_gross_sales,
  sum(net_sales)::DOUBLE AS total_net_sales, CAST(sum(return_quantity) AS BIGINT) AS total_return_quantity,
  (SELECT count(DISTINCT year_month) FROM national) AS total_months_in_window FROM national GROUP BY item_code),
stats AS (SELECT *, n_active_months / total_months_in_window::DOUBLE AS activity_rate,
  total_months_in_window / n_active_months::DOUBLE AS adi,
  CASE WHEN mean_nonzero_demand > 0 THEN std_nonzero_demand / mean_nonzero_demand ELSE 0 END AS cv FROM raw_stats),
classed AS (SELECT *, CASE WHEN activity_rate >= 0.8 AND cv < 0.5 THEN 'Continuous'
  WHEN activity_rate < 0.2 OR cv > 1.0 THEN 'Lumpy' ELSE 'Intermittent' END AS demand_class FROM stats)"""

STAT_LIST = """item_code, n_active_months, round(mean_nonzero_demand, 6) AS mean_nonzero_demand,
 round(std_nonzero_demand, 6) AS std_nonzero_demand, total_quantity, total_gross_sales, total_net_sales,
 total_return_quantity, round(activity_rate, 6) AS activity_rate, round(adi, 6) AS adi, round(cv, 6) AS cv,
 round(cv * cv, 6) AS cv2, total_months_in_window"""


def _quoted(text):
    return text.replace("'", "''")


def _case(table):
    return "CASE demand_class " + " ".join(f"WHEN '{k}' THEN '{_quoted(v)}'" for k, v in table.items()) + " END"


@query("cl1_national_sku_demand", f"WITH {GRID} SELECT item_code, year_month, {NATIONAL_SUMS} FROM grid GROUP BY ALL")
def _(spark, d):
    return i.tidy(i.national_sku(spark, d))


@query("cl2_activity_and_cv", f"WITH {STATS} SELECT {STAT_LIST} FROM stats")
def _(spark, d):
    return i.tidy(i.sku_stats(spark, d))


@query("cl3_demand_class", f"""WITH {STATS} SELECT item_code, round(activity_rate, 6) AS activity_rate, round(cv, 6) AS cv,
 demand_class FROM classed""")
def _(spark, d):
    return i.tidy(classify.classify(i.sku_stats(spark, d)).select("item_code", "activity_rate", "cv", "demand_class"))


@query("cl4_class_policies", f"WITH {STATS} SELECT item_code, demand_class, " + ", ".join(
    f"{_case(t)} AS {n}" for n, t in classify.POLICIES.items()) + " FROM classed")
def _(spark, d):
    return classify.classify(i.sku_stats(spark, d)).select("item_code", "demand_class", *classify.POLICIES)


@query("cl5_sku_dimensions", f"""WITH {STATS} SELECT item_code, demand_class, product_category, product_line, brand
 FROM classed LEFT JOIN product USING (item_code)""")
def _(spark, d):
    demand = i.sparse_demand(spark, d)
    out = classify.classify(i.sku_stats(spark, d)).join(classify.sku_dimensions(demand), "item_code", "left")
    return out.select("item_code", "demand_class", *facts.GOODS)


COLLAPSE, GROWTH = "Brand#3", "Brand#17"


@query("cl6_special_flags", f"""WITH {STATS} SELECT item_code, product_line, CASE product_line
 WHEN '{COLLAPSE}' THEN 'structural_collapse_trend' WHEN '{GROWTH}' THEN 'bass_diffusion_short_window' ELSE 'standard' END
 AS modeling_flag FROM classed LEFT JOIN product USING (item_code)""")
def _(spark, d):
    out = classify.item_classification(i.sparse_demand(spark, d), i.bounds(spark, d), COLLAPSE, GROWTH)
    return out.select("item_code", "product_line", "modeling_flag")


@query("cl7_class_counts", f"WITH {STATS} SELECT demand_class, count(*) AS n_skus FROM classed GROUP BY ALL ORDER BY 1")
def _(spark, d):
    out = classify.classify(i.sku_stats(spark, d))
    return classify.class_counts(out.select("item_code", "demand_class")).orderBy("demand_class")


# the part number as SKU: sparse items, so that the lumpy class appears too


@query("cl3_demand_class_by_part", f"""WITH {LINES.replace("p_brand || '|' || p_type AS item_code", "CAST(p_partkey AS VARCHAR) AS item_code")},
pairs AS (SELECT DISTINCT outlet_id, item_code FROM lines WHERE document_type = 'invoice'),
national AS (SELECT item_code, year_month, sum(quantity) FILTER (WHERE quantity > 0) AS q
  FROM lines SEMI JOIN pairs USING (outlet_id, item_code) GROUP BY ALL),
months AS (SELECT date_diff('month', min(document_date), max(document_date)) + 1 AS n FROM lines),
stats AS (SELECT item_code, count(q) / any_value(n)::DOUBLE AS activity_rate,
  CASE WHEN avg(q) > 0 THEN stddev_samp(q) / avg(q) ELSE 0 END AS cv FROM national, months GROUP BY item_code)
SELECT item_code, round(activity_rate, 6) AS activity_rate, round(cv, 6) AS cv, CASE WHEN activity_rate >= 0.8 AND cv < 0.5
 THEN 'Continuous' WHEN activity_rate < 0.2 OR cv > 1.0 THEN 'Lumpy' ELSE 'Intermittent' END AS demand_class FROM stats""")
def _(spark, d):
    parts = adapter.table(spark, d, "lineitem")
    orders = adapter.table(spark, d, "orders")
    base = parts.join(orders, parts.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderdate").cast("date").alias("document_date"),
        F.col("o_custkey").cast("string").alias("outlet_id"), F.col("l_partkey").cast("string").alias("item_code"),
        F.when(F.col("l_returnflag") == "R", "return").otherwise("invoice").alias("document_type"),
        (F.col("l_quantity").cast("bigint") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("quantity"),
        F.lit(0).cast("decimal(18,4)").alias("net_sales"), F.lit("all").alias("territory_id"),
    )
    demand = facts.pair_months(facts.with_month(base))
    stats = classify.activity_and_cv(facts.national_sku_demand(demand), classify.month_count(i.bounds(spark, d)))
    return i.tidy(classify.classify(stats).select("item_code", "activity_rate", "cv", "demand_class"))
