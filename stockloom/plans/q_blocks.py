"""Sources, cleaning steps, joins, aggregates, windows and sorts on the supplied tables."""

from pyspark.sql import Window, functions as F

from stockloom.functions import clean
from stockloom.operators import facts, relational as rel
from stockloom.operators.ordering import global_rank, quantiles, running_totals
from stockloom.plans import inputs as i
from stockloom.plans.q_facts import delivered_lines
from stockloom.plans.registry import query
from stockloom.plans.sqlparts import BASE, GRID
from stockloom.sources import adapter, io
from stockloom.sources.staging import stage_path

T = adapter.table


def scratch(spark, name):
    """A new path in the stage folder."""
    return f"{stage_path(spark, 'scratch')}/{name}"


# -- sources and sinks --------------------------------------------------------

CUSTOMER = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal double, c_mktsegment string"


def customers(spark, d):
    return T(spark, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("bigint"))


@query("io1_csv_source", CUSTOMER)
def _(spark, d):
    path = scratch(spark, "customer.csv")
    customers(spark, d).write.option("header", True).csv(path)
    return io.read_csv(spark, path, CUSTOMER_SCHEMA)


@query("io1_csv_inferred", CUSTOMER)
def _(spark, d):
    path = scratch(spark, "customer.csv")
    customers(spark, d).write.option("header", True).csv(path)
    return io.read_csv(spark, path).withColumns({"c_custkey": F.col("c_custkey").cast("bigint"), "c_nationkey": F.col("c_nationkey").cast("bigint")})


@query("io2_parquet_source", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(spark, d):
    return io.read_parquet(spark, f"{d}/orders.parquet").drop("o_orderdate")


@query("io3_pushed_down_scan", """SELECT l_orderkey, l_quantity FROM lineitem
 WHERE l_returnflag = 'R' AND l_quantity >= 40""")
def _(spark, d):
    lines = io.read_parquet(spark, f"{d}/lineitem.parquet")
    return lines.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40)).select("l_orderkey", "l_quantity")


@query("io4_json_source", CUSTOMER)
def _(spark, d):
    path = scratch(spark, "customer.json")
    customers(spark, d).write.json(path)
    return io.read_any(spark, path, CUSTOMER_SCHEMA)


@query("io5_parquet_sink", CUSTOMER)
def _(spark, d):
    return io.read_parquet(spark, io.write_parquet(customers(spark, d), scratch(spark, "a/b/customer.parquet")))


@query("io6_zstd_sink", CUSTOMER)
def _(spark, d):
    return io.read_parquet(spark, io.write_parquet(customers(spark, d), scratch(spark, "customer.parquet"), "zstd"))


@query("io7_dual_export", "SELECT c_mktsegment, count(*) AS n, 'parquet' AS format FROM customer GROUP BY 1 "
       "UNION ALL SELECT c_mktsegment, count(*), 'csv' FROM customer GROUP BY 1")
def _(spark, d):
    summary = T(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    parquet, csv = io.export_summary(summary, scratch(spark, "out"), "segments")
    back = io.read_any(spark, parquet).withColumn("format", F.lit("parquet"))
    return back.unionByName(io.read_any(spark, csv, "c_mktsegment string, n bigint").withColumn("format", F.lit("csv")))


@query("io8_write_then_scan", f"WITH {BASE} SELECT item_code, count(*) AS n_lines, CAST(sum(quantity) AS BIGINT) AS quantity FROM base GROUP BY 1")
def _(spark, d):
    stage = io.write_then_scan(i.base_sales(spark, d).select("item_code", "quantity"), scratch(spark, "base.parquet"))
    return stage.groupBy("item_code").agg(F.count("*").alias("n_lines"), F.sum("quantity").alias("quantity"))


@query("io9_reader_by_extension", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    return io.read_any(spark, f"{d}/part.parquet").groupBy("p_brand").agg(F.count("*").alias("n"))


NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@query("io10_schema_listing", "SELECT table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY column_index) AS BIGINT) AS position, "
       "column_name FROM duckdb_columns() WHERE table_name IN (" + ", ".join(f"'{n}'" for n in NAMES) + ")")
def _(spark, d):
    rows = io.schema_rows({n: T(spark, d, n) for n in NAMES})
    return rows.select("table_name", F.col("position").cast("bigint").alias("position"), "column_name")


@query("io11_required_columns", "SELECT count(*) AS n_rows FROM lineitem")
def _(spark, d):
    lines = io.require_columns(T(spark, d, "lineitem"), ["l_orderkey", "l_quantity", "l_returnflag"], "lineitem")
    return lines.agg(F.count("*").alias("n_rows"))


@query("io12_table_report", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS n_rows, "
    f"(SELECT count(*) FROM duckdb_columns() WHERE table_name = '{n}') AS n_columns" for n in NAMES))
def _(spark, d):
    return io.table_report({n: T(spark, d, n) for n in NAMES})


# -- cleaning -----------------------------------------------------------------

@query("pj1_column_names", """SELECT CAST(l_orderkey AS VARCHAR) AS documnet_number, CAST(o_custkey AS VARCHAR) AS outlet_id,
 CAST(l_suppkey AS VARCHAR) AS route_id, 'Yes' AS is_direct_distributor, CAST(l_quantity AS BIGINT) AS quantity
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, d):
    return clean.snake_columns(delivered_lines(spark, d)).select(
        "documnet_number", "outlet_id", "route_id", "is_direct_distributor", "quantity")


@query("pj2_text_values", r"""SELECT c_custkey, regexp_replace(regexp_replace(lower(trim(c_name)), '[\s\-]+', '_', 'g'), '[^\w]', '', 'g') AS c_name,
 lower(c_mktsegment) AS c_mktsegment FROM customer""")
def _(spark, d):
    return clean.snake_values(T(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query("pj3_ids_to_text", "SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_totalprice FROM orders")
def _(spark, d):
    return clean.ids_to_text(T(spark, d, "orders"), ["o_custkey", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("pj4_drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def _(spark, d):
    return T(spark, d, "orders").drop("o_orderstatus", "o_orderdate")


@query("pj5_signed_quantity", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
 CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity FROM lineitem""")
def _(spark, d):
    return T(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        clean.signed_quantity("l_quantity", "l_returnflag", "R").alias("quantity"))


@query("pj6_date_and_month", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS document_date, strftime(o_orderdate, '%Y-%m') AS year_month FROM orders")
def _(spark, d):
    text = F.date_format("o_orderdate", "yyyy_MM_dd").alias("document_date")
    out = facts.parse_month(T(spark, d, "orders").select("o_orderkey", text))
    return out.withColumn("document_date", F.col("document_date").cast("string"))


@query("pj7_year_and_month_parts", "SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month_int FROM orders")
def _(spark, d):
    ym = clean.month_text(F.col("o_orderdate"))
    out = T(spark, d, "orders").select("o_orderkey", clean.year_of(ym).alias("year"), clean.month_of(ym).alias("month_int"))
    return i.tidy(out)


@query("pj8_filters", f"""WITH {BASE} SELECT document_number, item_code, quantity FROM base WHERE document_type = 'invoice'
 AND region IN ('ASIA', 'EUROPE') AND year_month BETWEEN '1996-01' AND '1997-12'""")
def _(spark, d):
    b = i.base_sales(spark, d)
    return b.where(
        (F.col("document_type") == "invoice") & F.col("region").isin("ASIA", "EUROPE")
        & F.col("year_month").between("1996-01", "1997-12")).select("document_number", "item_code", "quantity")


@query("pj9_finite_rows", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL AND isfinite(c_acctbal)")
def _(spark, d):
    return clean.keep_finite(T(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])


@query("pj10_fill_nulls", """SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(top, 'none') AS top_priority FROM customer
 LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS top FROM orders GROUP BY 1)
 ON c_custkey = o_custkey""")
def _(spark, d):
    orders = T(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"), F.max("o_orderpriority").alias("top_priority"))
    joined = T(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    return clean.fill_nulls(joined, {"n_orders": 0, "top_priority": "none"})


@query("pj11_searched_case", """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END
 AS size_class FROM part""")
def _(spark, d):
    size = F.col("p_size")
    return T(spark, d, "part").select("p_partkey", F.when(size < 10, "small").when(size < 30, "medium").otherwise("large").alias("size_class"))


@query("pj12_remap", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 WHEN 'P' THEN 2 END::BIGINT AS code FROM orders")
def _(spark, d):
    return T(spark, d, "orders").select("o_orderkey", clean.remap(F.col("o_orderstatus"), {"O": 0, "F": 1, "P": 2}).cast("bigint").alias("code"))


@query("pj13_constant_with_default", """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 0.118 WHEN 'STANDARD' THEN 0.0916 ELSE 0 END::DOUBLE
 AS category_return_rate FROM part""")
def _(spark, d):
    return T(spark, d, "part").select("p_partkey", clean.remap(F.col("p_type"), {"ECONOMY": 0.118, "STANDARD": 0.0916}, 0.0).alias("category_return_rate"))


@query("pj14_winsorise", """WITH e AS (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM customer)
SELECT c_custkey, round(least(greatest(c_acctbal, lo), hi), 6) AS c_acctbal_winsor FROM customer, e""")
def _(spark, d):
    out = rel.winsorise(T(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return i.tidy(out.drop("c_acctbal"))


@query("pj15_rename_and_reorder", "SELECT c_mktsegment AS outlet_segment, c_custkey AS outlet_key, c_acctbal AS outlet_balance FROM customer")
def _(spark, d):
    renamed = T(spark, d, "customer").withColumnsRenamed(
        {"c_custkey": "outlet_key", "c_acctbal": "outlet_balance", "c_mktsegment": "outlet_segment"})
    return renamed.select("outlet_segment", "outlet_key", "outlet_balance")


@query("pj16_feature_columns", "SELECT c_acctbal, c_nationkey::BIGINT AS c_nationkey FROM customer")
def _(spark, d):
    df = T(spark, d, "customer")
    keep = clean.feature_columns(df.columns, "c_mktsegment", {"identifiers": ["c_custkey", "c_name"]})
    return i.tidy(df.select(*keep))


# -- joins --------------------------------------------------------------------

@query("jn1_dimension_join", f"""WITH {BASE} SELECT document_number, item_code, territory_id, product_category, brand, region, district FROM base""")
def _(spark, d):
    out = facts.attach_dimensions(i.sales(spark, d), i.product(spark, d), i.region(spark, d))
    return out.select("document_number", "item_code", "territory_id", "product_category", "brand", "region", "district")


@query("jn2_composite_key_join", f"""WITH {BASE}, a AS (SELECT outlet_id, year_month, sum(quantity) AS q FROM base GROUP BY ALL)
SELECT outlet_id, year_month, CAST(coalesce(q, 0) AS BIGINT) AS quantity FROM (SELECT DISTINCT outlet_id FROM base) CROSS JOIN spine LEFT JOIN a USING (outlet_id, year_month)""")
def _(spark, d):
    base = i.base_sales(spark, d)
    sums = base.groupBy("outlet_id", "year_month").agg(F.sum("quantity").alias("quantity"))
    return facts.fill_months(sums, ["outlet_id"], i.bounds(spark, d), {"quantity": 0})


@query("jn3_entity_month_spine", f"WITH {BASE} SELECT territory_id, year_month FROM places CROSS JOIN spine")
def _(spark, d):
    return i.region(spark, d).select("territory_id").crossJoin(F.broadcast(i.spine(spark, d)))


@query("jn4_join_to_own_aggregate", """SELECT p_partkey, round(p_retailprice / avg(p_retailprice) OVER (PARTITION BY p_brand), 6) AS index_in_brand FROM part""")
def _(spark, d):
    part = T(spark, d, "part")
    means = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("_mean"))
    return i.tidy(part.join(means, "p_brand").select("p_partkey", clean.ratio(F.col("p_retailprice"), F.col("_mean")).alias("index_in_brand")))


@query("jn5_semi_join", """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem l SEMI JOIN
 (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') r USING (l_orderkey, l_partkey, l_suppkey)""")
def _(spark, d):
    lines = T(spark, d, "lineitem")
    keys = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_suppkey")
    return lines.join(keys, keys.columns, "left_semi").select(*keys.columns, "l_quantity")


@query("jn6_orphans", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    orders = T(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return rel.orphans(T(spark, d, "customer"), orders, "c_custkey")


@query("jn7_match_rate", f"""WITH {BASE}, s AS (SELECT 'item_code' AS key, count(*) AS n_rows, count(*) FILTER (WHERE product_category IS NULL) AS unmatched FROM base
 UNION ALL SELECT 'territory_id', count(*), count(*) FILTER (WHERE region IS NULL) FROM base)
SELECT key, n_rows, unmatched, round((n_rows - unmatched) * 100.0::DOUBLE / n_rows, 6) AS match_pct, (n_rows - unmatched) * 100.0::DOUBLE / n_rows >= 98 AS passed FROM s""")
def _(spark, d):
    sales = i.sales(spark, d)
    return i.tidy(rel.match_rate(sales, i.product(spark, d), "item_code").unionByName(rel.match_rate(sales, i.region(spark, d), "territory_id")))


@query("jn8_sampled_keys", f"""WITH {BASE} SELECT outlet_id, document_number, item_code, quantity FROM base
 WHERE outlet_id IN (SELECT outlet_id FROM (SELECT DISTINCT outlet_id FROM base) ORDER BY md5(outlet_id), outlet_id LIMIT 100)""")
def _(spark, d):
    return rel.hash_sample(i.sales(spark, d), "outlet_id", 100).select("outlet_id", "document_number", "item_code", "quantity")


@query("jn9_multi_way_merge", """SELECT o_orderkey, c_mktsegment, n_name, r_name, coalesce(n_lines, 0) AS n_lines FROM orders
 LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
 LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def _(spark, d):
    counts = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    c = T(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    n = T(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = T(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    out = (T(spark, d, "orders").join(counts, "o_orderkey", "left").join(c, "o_custkey", "left")
           .join(n, "c_nationkey", "left").join(r, "n_regionkey", "left"))
    return out.select("o_orderkey", "c_mktsegment", "n_name", "r_name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query("jn10_segment_join", """SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
 WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')""")
def _(spark, d):
    c = T(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    out = T(spark, d, "orders").join(c, "o_custkey", "left").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE"))
    return out.select("o_orderkey", "c_mktsegment")


# -- aggregates ---------------------------------------------------------------

@query("ag1_group_aggregates", """SELECT p_brand, sum(p_size)::BIGINT AS total_size, round(avg(p_size), 6) AS mean_size, min(p_size)::BIGINT AS min_size,
 max(p_size)::BIGINT AS max_size, count(*) AS n, min(p_name) AS first_name FROM part GROUP BY 1""")
def _(spark, d):
    return i.tidy(T(spark, d, "part").groupBy("p_brand").agg(
        F.sum("p_size").alias("total_size"), F.avg("p_size").alias("mean_size"), F.min("p_size").alias("min_size"),
        F.max("p_size").alias("max_size"), F.count("*").alias("n"), F.min("p_name").alias("first_name")))


@query("ag2_conditional_sums", f"""WITH {BASE} SELECT item_code, CAST(sum(quantity) FILTER (WHERE quantity > 0) AS BIGINT) AS gross_quantity,
 CAST(-sum(quantity) FILTER (WHERE quantity < 0) AS BIGINT) AS return_quantity FROM base GROUP BY 1""")
def _(spark, d):
    m = facts.line_measures()
    return i.base_sales(spark, d).groupBy("item_code").agg(*[m[c].alias(c) for c in ("gross_quantity", "return_quantity")])


@query("ag3_conditional_counts", f"""WITH {BASE} SELECT outlet_id, count(*) FILTER (WHERE document_type = 'invoice') AS n_invoices,
 count(*) FILTER (WHERE document_type = 'return') AS n_returns FROM base GROUP BY 1""")
def _(spark, d):
    m = facts.line_measures()
    return i.base_sales(spark, d).groupBy("outlet_id").agg(*[m[c].alias(c) for c in ("n_invoices", "n_returns")])


@query("ag4_nonzero_statistics", f"""WITH {GRID}, m AS (SELECT item_code, year_month, sum(net_quantity)::BIGINT AS q FROM grid GROUP BY ALL)
SELECT item_code, count(*) FILTER (WHERE q > 0) AS n, round(avg(q) FILTER (WHERE q > 0), 6) AS mean, round(stddev_samp(q) FILTER (WHERE q > 0), 6) AS std FROM m GROUP BY 1""")
def _(spark, d):
    sold = F.when(F.col("net_quantity") > 0, F.col("net_quantity"))
    return i.tidy(i.national_sku(spark, d).groupBy("item_code").agg(
        F.count(sold).alias("n"), F.avg(sold).alias("mean"), F.stddev_samp(sold).alias("std")))


@query("ag5_distinct_counts", f"WITH {BASE} SELECT outlet_id, count(DISTINCT item_code) AS n_skus, count(DISTINCT product_category) AS n_categories FROM base GROUP BY 1")
def _(spark, d):
    return i.base_sales(spark, d).groupBy("outlet_id").agg(
        F.countDistinct("item_code").alias("n_skus"), F.countDistinct("product_category").alias("n_categories"))


@query("ag6_distinct_by_key", """SELECT p_brand, p_type, min(p_name) AS p_name FROM part GROUP BY 1, 2""")
def _(spark, d):
    return facts.home_attributes(T(spark, d, "part"), ["p_brand", "p_type"], ["p_name"])


@query("ag7_modal_value", """SELECT o_custkey, o_orderpriority AS mode FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (
 PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS pos FROM orders GROUP BY 1, 2) WHERE pos = 1""")
def _(spark, d):
    return facts.modal_value(T(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "mode")


PROBS = (0.01, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


@query("ag8_exact_quantiles", "SELECT " + ", ".join(
    f"round(quantile_cont({c}, {p}), 6) AS {c}_p{round(p * 100):02d}" for c in ("l_quantity", "l_extendedprice") for p in PROBS) + " FROM lineitem")
def _(spark, d):
    return i.tidy(quantiles(T(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], list(PROBS)))


@query("ag8_grouped_quantiles", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS l_extendedprice_p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS l_extendedprice_p50,
 round(quantile_cont(l_extendedprice, 0.75), 6) AS l_extendedprice_p75 FROM lineitem GROUP BY 1""")
def _(spark, d):
    return i.tidy(quantiles(T(spark, d, "lineitem"), ["l_extendedprice"], [0.25, 0.5, 0.75], ["l_returnflag"]))


def describe_sql(table, columns, by=None):
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS feature, count({c}) AS n, round(avg({c}::DOUBLE), 4) AS mean, round(stddev_samp({c}::DOUBLE), 4) AS std, "
        f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, "
        f"round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75 FROM {table}{group}" for c in columns)


def r4(df, keep=()):
    return df.select(*[F.round(c, 4).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@query("ag9_describe", describe_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def _(spark, d):
    return r4(rel.describe(T(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), ("min", "max"))


@query("ag10_value_counts", """SELECT CAST(l_quantity AS VARCHAR) AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem), 6) AS pct
 FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 30""")
def _(spark, d):
    return i.tidy(rel.value_counts(T(spark, d, "lineitem"), "l_quantity"))


FLAGS = ["A", "N", "R"]


@query("ag11_pivot", "SELECT p_type, " + ", ".join(f"count(*) FILTER (WHERE l_returnflag = '{f}') AS {f}" for f in FLAGS) +
       " FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(spark, d):
    j = T(spark, d, "lineitem").join(T(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rel.contingency(j, "p_type", "l_returnflag", FLAGS, F.count(F.lit(1)))


@query("ag12_share_of_total", "SELECT p_brand, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 6) AS share FROM part GROUP BY 1")
def _(spark, d):
    counted = T(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return i.tidy(rel.share_of_total(counted, "n").drop("n"))


@query("ag13_share_in_row", """SELECT c_mktsegment, o_orderpriority, round(count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment)::DOUBLE, 6) AS share
 FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def _(spark, d):
    j = T(spark, d, "orders").join(T(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counted = j.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))
    return i.tidy(rel.share_in_group(counted, "n", ["c_mktsegment"]).drop("n"))


@query("ag14_skewness", " UNION ALL ".join(f"""SELECT '{c}' AS feature, round((avg({c}^3) - 3*avg({c})*avg({c}^2) + 2*avg({c})^3) / var_pop({c})^1.5, 4) AS skewness FROM lineitem"""
       for c in ("l_quantity", "l_discount")))
def _(spark, d):
    return r4(rel.skewness(T(spark, d, "lineitem"), ["l_quantity", "l_discount"]))


@query("ag15_multi_level_rollup", f"""WITH {BASE}, m AS (SELECT item_code, year_month, sum(quantity) AS q FROM base GROUP BY ALL),
y AS (SELECT item_code, left(year_month, 4)::BIGINT AS year, sum(q) AS q, count(*) AS n_months FROM m GROUP BY ALL)
SELECT item_code, CAST(sum(q) AS BIGINT) AS quantity, CAST(max(q) AS BIGINT) AS best_year, count(*) AS n_years, CAST(sum(n_months) AS BIGINT) AS n_months FROM y GROUP BY 1""")
def _(spark, d):
    month = i.base_sales(spark, d).groupBy("item_code", "year_month").agg(F.sum("quantity").alias("q"))
    year = month.groupBy("item_code", clean.year_of(F.col("year_month")).alias("year")).agg(F.sum("q").alias("q"), F.count("*").alias("n_months"))
    return year.groupBy("item_code").agg(F.sum("q").alias("quantity"), F.max("q").alias("best_year"), F.count("*").alias("n_years"), F.sum("n_months").alias("n_months"))


@query("ag16_guarded_ratio", f"""WITH {BASE} SELECT outlet_id, round(sum(quantity) FILTER (WHERE quantity < 0)::DOUBLE / nullif(sum(quantity) FILTER (WHERE quantity > 0), 0), 6) AS return_ratio FROM base GROUP BY 1""")
def _(spark, d):
    q = F.col("quantity")
    return i.tidy(i.base_sales(spark, d).groupBy("outlet_id").agg(clean.ratio(F.sum(F.when(q < 0, q)), F.sum(F.when(q > 0, q))).alias("return_ratio")))


@query("ag17_grouped_describe", describe_sql("lineitem", ["l_quantity", "l_extendedprice"], "l_returnflag"))
def _(spark, d):
    return r4(rel.describe(T(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"]), ("min", "max"))


@query("ag18_histogram", """WITH e AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 40)), 39)::BIGINT AS bin, round(any_value(lo) + bin * any_value((hi - lo) / 40), 4) AS bin_start, count(*) AS n
FROM lineitem, e WHERE l_extendedprice BETWEEN lo AND hi GROUP BY 1""")
def _(spark, d):
    lines = T(spark, d, "lineitem").select("l_extendedprice")
    edges = quantiles(lines, ["l_extendedprice"], [0.01, 0.99])
    out = rel.histogram(lines, "l_extendedprice", 40, F.col("l_extendedprice_p01"), F.col("l_extendedprice_p99"), edges)
    return r4(out)


# -- windows (monthly series per SKU) -----------------------------------------

SERIES = f"{GRID}, s AS (SELECT item_code, year_month, sum(net_quantity)::BIGINT AS q FROM grid GROUP BY ALL)"
KEYS = ["item_code"]


def series(spark, d):
    return i.national_sku(spark, d).select("item_code", "year_month", F.col("net_quantity").alias("q"))


def window_query(name, sql, *columns):
    @query(name, f"WITH {SERIES} SELECT item_code, year_month, {sql} FROM s WINDOW w AS (PARTITION BY item_code ORDER BY year_month)")
    def _(spark, d):
        w = Window.partitionBy(*KEYS).orderBy("year_month")
        return i.tidy(series(spark, d).select("item_code", "year_month", *columns_of(columns, w)))


def columns_of(makers, w):
    return [make(w).alias(name) for name, make in makers]


LAGS = (1, 2, 3, 6, 12)


def q():
    return F.col("q")


window_query("wn1_lags", ", ".join(f"(lag(q, {n}) OVER w)::DOUBLE AS lag_{n}" for n in LAGS),
             *[(f"lag_{n}", lambda w, n=n: F.lag(q(), n).over(w).cast("double")) for n in LAGS])
window_query("wn2_lead", "(lead(q, 2) OVER w)::DOUBLE AS lead_2", ("lead_2", lambda w: F.lead(q(), 2).over(w).cast("double")))
window_query("wn3_rolling_mean", ", ".join(
    f"round(avg(q) OVER (PARTITION BY item_code ORDER BY year_month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS mean_{n}" for n in (3, 6, 12)),
    *[(f"mean_{n}", lambda w, n=n: F.avg(q()).over(rel.trailing(KEYS, n))) for n in (3, 6, 12)])
window_query("wn4_rolling_std", ", ".join(
    f"round(stddev_samp(q) OVER (PARTITION BY item_code ORDER BY year_month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS std_{n}" for n in (3, 6, 12)),
    *[(f"std_{n}", lambda w, n=n: F.stddev_samp(q()).over(rel.trailing(KEYS, n))) for n in (3, 6, 12)])
window_query("wn5_rolling_sum", ", ".join(
    f"sum(q) OVER (PARTITION BY item_code ORDER BY year_month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)::BIGINT AS sum_{n}" for n in (3, 6, 12)),
    *[(f"sum_{n}", lambda w, n=n: F.sum(q()).over(rel.trailing(KEYS, n))) for n in (3, 6, 12)])
window_query("wn6_centred_mean", ", ".join(
    f"CASE WHEN count(q) OVER f{n} = {n} THEN round(avg(q) OVER f{n}, 6) END AS ma{n}" for n in (3, 12)).replace(
        "OVER f3", "OVER (PARTITION BY item_code ORDER BY year_month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)").replace(
        "OVER f12", "OVER (PARTITION BY item_code ORDER BY year_month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)"),
    *[(f"ma{n}", lambda w, n=n: rel.centred_mean(q(), KEYS, n)) for n in (3, 12)])
window_query("wn7_percent_change", ", ".join(
    f"round((q - lag(q, {n}) OVER w)::DOUBLE / nullif(lag(q, {n}) OVER w, 0)::DOUBLE * 100, 6) AS change_{n}" for n in (1, 12)),
    *[(f"change_{n}", lambda w, n=n: rel.percent_change(q(), KEYS, n)) for n in (1, 12)])
window_query("wn8_rank_and_size", "row_number() OVER w AS pos, count(*) OVER (PARTITION BY item_code) AS n",
             ("pos", lambda w: F.row_number().over(w)), ("n", lambda w: F.count("*").over(Window.partitionBy(*KEYS))))
window_query("wn9_sequence_index", "row_number() OVER w - 1 AS idx", ("idx", lambda w: F.row_number().over(w) - 1))
window_query("wn10_running_sum", "sum(q) OVER w::BIGINT AS running".replace("OVER w::BIGINT", "OVER (PARTITION BY item_code ORDER BY year_month)::BIGINT"),
             ("running", lambda w: F.sum(q()).over(w.rowsBetween(Window.unboundedPreceding, 0))))
window_query("wn11_forward_fill", "(last_value(CASE WHEN q > 50 THEN q END IGNORE NULLS) OVER (PARTITION BY item_code ORDER BY year_month ROWS UNBOUNDED PRECEDING))::DOUBLE AS filled",
             ("filled", lambda w: rel.last_seen(F.when(q() > 50, q()), KEYS).cast("double")))


@query("wn12_position_in_run", f"""WITH {SERIES}, r AS (SELECT *, sum((q > 50)::INT) OVER (PARTITION BY item_code ORDER BY year_month) AS run FROM s)
SELECT item_code, year_month, row_number() OVER (PARTITION BY item_code, run ORDER BY year_month) - 1 AS pos FROM r""")
def _(spark, d):
    w = Window.partitionBy("item_code").orderBy("year_month")
    run = F.sum((q() > 50).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = series(spark, d).withColumn("run", run)
    pos = F.row_number().over(Window.partitionBy("item_code", "run").orderBy("year_month")) - 1
    return i.tidy(marked.select("item_code", "year_month", pos.alias("pos")))


@query("wn13_share_within_year", f"""WITH {SERIES}, y AS (SELECT item_code, left(year_month, 4)::BIGINT AS year, sum(q) AS q FROM s GROUP BY ALL)
SELECT item_code, year, round(q::DOUBLE / sum(q) OVER (PARTITION BY year)::DOUBLE, 6) AS share FROM y""")
def _(spark, d):
    yearly = series(spark, d).groupBy("item_code", clean.year_of(F.col("year_month")).alias("year")).agg(F.sum("q").alias("q"))
    return i.tidy(rel.share_in_group(yearly, "q", ["year"]).select("item_code", "year", "share"))


@query("wn14_global_rank", """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders""")
def _(spark, d):
    orders = T(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return global_rank(orders, [(-F.col("o_totalprice")).alias("_neg"), F.col("o_orderkey")]).drop("o_totalprice")


@query("wn10_global_running_total", """SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER (ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS running FROM orders""")
def _(spark, d):
    orders = T(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    out = running_totals(orders, [(-F.col("price")).alias("_neg"), F.col("o_orderkey")], {"running": F.col("price")})
    return i.tidy(out.drop("price"))


# -- sorts and set operations -------------------------------------------------

@query("sr1_multi_key_sort", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type DESC")
def _(spark, d):
    return T(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand", F.desc("p_type"))


@query("sr2_top_k", "SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 10")
def _(spark, d):
    sums = T(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return sums.orderBy(F.desc("total"), "o_custkey").limit(10)


@query("sr3_preview", f"""WITH {BASE} SELECT * REPLACE (CAST(document_date AS VARCHAR) AS document_date, CAST(net_sales AS DOUBLE) AS net_sales, CAST(discount AS DOUBLE) AS discount)
 FROM base ORDER BY document_number, item_code, route_id, quantity, net_sales, discount LIMIT 5""")
def _(spark, d):
    first = i.base_sales(spark, d).orderBy("document_number", "item_code", "route_id", "quantity", "net_sales", "discount").limit(5)
    return i.tidy(first.withColumn("document_date", F.col("document_date").cast("string")))


@query("st1_union_by_name", """(SELECT o_custkey, count(*) AS n, 'top' AS part FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 5)
 UNION ALL (SELECT o_custkey, count(*) AS n, 'bottom' AS part FROM orders GROUP BY 1 ORDER BY n, o_custkey LIMIT 5)""")
def _(spark, d):
    counted = T(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "o_custkey").limit(5).withColumn("part", F.lit("top"))
    return top.unionByName(counted.orderBy("n", "o_custkey").limit(5).select(F.lit("bottom").alias("part"), "n", "o_custkey"))


@query("st2_month_difference", f"""WITH {BASE} SELECT year_month FROM spine WHERE year_month NOT IN
 (SELECT year_month FROM base)""")
def _(spark, d):
    seen = i.base_sales(spark, d).select("year_month")
    return i.spine(spark, d).join(seen, "year_month", "left_anti")


# -- scalar functions ---------------------------------------------------------

@query("sc1_text_functions", """SELECT p_partkey, lower(trim(p_name)) AS name, replace(p_brand, '#', '-') AS brand, left(p_type, 3) AS kind,
 p_brand || '/' || p_type AS joined FROM part""")
def _(spark, d):
    return T(spark, d, "part").select("p_partkey", F.lower(F.trim("p_name")).alias("name"), F.regexp_replace("p_brand", "#", "-").alias("brand"),
                                      F.substring("p_type", 1, 3).alias("kind"), F.concat("p_brand", F.lit("/"), "p_type").alias("joined"))


@query("sc2_date_functions", """SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, strftime(o_orderdate - INTERVAL 11 MONTH, '%Y-%m') AS start_month,
 (2002 - year(o_orderdate)) * 12 + 1 - month(o_orderdate) AS months_to_2002 FROM orders""")
def _(spark, d):
    day = F.trunc("o_orderdate", "month")
    return i.tidy(T(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        F.date_format(F.add_months("o_orderdate", -11), "yyyy-MM").alias("start_month"),
        F.months_between(F.lit("2002-01-01").cast("date"), day).cast("bigint").alias("months_to_2002")))


@query("sc3_math_functions", """SELECT l_orderkey, l_partkey, l_suppkey, round(ln(1 + l_quantity), 6) AS log1p, round(exp(l_discount) - 1, 6) AS expm1, abs(l_tax - l_discount) AS gap,
 round(pow(l_quantity, 1.5), 6) AS power, round(sin(l_quantity), 6) AS sine, round(cos(l_quantity), 6) AS cosine, round(sqrt(l_quantity), 6) AS root FROM lineitem""")
def _(spark, d):
    x = F.col("l_quantity")
    return T(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", i.r6(F.log1p(x)).alias("log1p"), i.r6(F.expm1("l_discount")).alias("expm1"),
        F.abs(F.col("l_tax") - F.col("l_discount")).alias("gap"), i.r6(F.pow(x, F.lit(1.5))).alias("power"),
        i.r6(F.sin(x)).alias("sine"), i.r6(F.cos(x)).alias("cosine"), i.r6(F.sqrt(x)).alias("root"))


@query("sc4_casts", "SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_returnflag = 'R' AS INT)::BIGINT AS is_return, CAST(l_linenumber AS VARCHAR) AS line FROM lineitem")
def _(spark, d):
    return T(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("bigint").alias("quantity"),
                                          (F.col("l_returnflag") == "R").cast("bigint").alias("is_return"), F.col("l_linenumber").cast("string").alias("line"))


@query("sc5_null_functions", """SELECT c_custkey, coalesce(o_orderpriority, 'none') AS priority, o_orderkey IS NULL AS never FROM customer
 LEFT JOIN orders ON o_custkey = c_custkey""")
def _(spark, d):
    orders = T(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = T(spark, d, "customer").join(orders, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("o_orderpriority", F.lit("none")).alias("priority"), F.col("o_orderkey").isNull().alias("never"))
