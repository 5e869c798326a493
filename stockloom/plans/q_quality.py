"""Data-quality profiles, findings and readiness."""

from pyspark.sql import functions as F

from stockloom.functions.clean import year_of
from stockloom.operators import facts, quality as dq
from stockloom.operators.relational import describe
from stockloom.plans import inputs as i
from stockloom.plans.q_blocks import describe_sql, r4
from stockloom.plans.registry import query
from stockloom.plans.sqlparts import BASE

# a view of the lines with a sparse text column, a constant and a skewed number
COLUMNS = {
    "document_number": False, "territory_id": False, "document_type": False, "payment_term": False, "channel_id": False,
    "quantity": True, "discount": True, "sales_sq": True, "batch": True,
}
PROFILED = f"""{BASE}, profiled AS (SELECT document_number, territory_id, document_type,
 CASE WHEN payment_term <> '4-NOT SPECIFIED' THEN payment_term END AS payment_term,
 CASE WHEN year_month >= '1995-02' THEN 'main' ELSE 'old' END AS channel_id, quantity, discount,
 net_sales::DOUBLE * net_sales::DOUBLE * quantity AS sales_sq, 7 AS batch FROM base)"""


def profiled(spark, d):
    sales = F.col("net_sales").cast("double")
    return i.base_sales(spark, d).select(
        "document_number", "territory_id", "document_type",
        F.when(F.col("payment_term") != "4-NOT SPECIFIED", F.col("payment_term")).alias("payment_term"),
        F.when(F.col("year_month") >= "1995-02", "main").otherwise("old").alias("channel_id"), "quantity", "discount",
        (sales * sales * F.col("quantity")).alias("sales_sq"), F.lit(7).alias("batch"))


def _profile_sql():
    parts = []
    for c, number in COLUMNS.items():
        stats = ", ".join(
            f"{f} AS {n}" for n, f in (
                ("mean", f"round(avg({c}::DOUBLE), 4)"), ("std", f"round(stddev_samp({c}::DOUBLE), 4)"), ("min", f"round(min({c})::DOUBLE, 4)"),
                ("p25", f"round(quantile_cont({c}::DOUBLE, 0.25), 4)"), ("median", f"round(quantile_cont({c}::DOUBLE, 0.5), 4)"),
                ("p75", f"round(quantile_cont({c}::DOUBLE, 0.75), 4)"), ("max", f"round(max({c})::DOUBLE, 4)"))
        ) if number else ", ".join(f"NULL::DOUBLE AS {n}" for n in ("mean", "std", "min", "p25", "median", "p75", "max"))
        parts.append(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_unique, "
                     f"{stats}, round(CAST(CAST((count(*) - count({c}))::DOUBLE / count(*) * 100 AS VARCHAR) AS DECIMAL(38,18)), 2)::DOUBLE AS null_pct, {str(number).upper()} AS is_numeric FROM profiled")
    return " UNION ALL ".join(parts)


PROFILE_CTE = f"{PROFILED}, prof AS ({_profile_sql()})"


@query("dq1_profile", f"WITH {PROFILE_CTE} SELECT * REPLACE (CASE WHEN column_name = 'sales_sq' THEN round(mean / 1e9, 3) ELSE mean END AS mean, "
       "CASE WHEN column_name = 'sales_sq' THEN round(std / 1e9, 3) ELSE std END AS std) FROM prof")
def _(spark, d):
    out = dq.profile(profiled(spark, d))
    big = F.col("column_name") == "sales_sq"
    return out.withColumns({c: F.when(big, F.round(F.col(c) / 1e9, 3)).otherwise(F.col(c)) for c in ("mean", "std")})


TEXTS = [c for c, number in COLUMNS.items() if not number]
TOP_CTE = "freq AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n FROM profiled GROUP BY 2" for c in TEXTS) + """),
top AS (SELECT column_name, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value NULLS LAST) AS position, value, n,
 round(CAST(CAST(n::DOUBLE / sum(n) OVER (PARTITION BY column_name) * 100 AS VARCHAR) AS DECIMAL(38,18)), 2)::DOUBLE AS pct, count(value) OVER (PARTITION BY column_name) AS u FROM freq)"""


@query("dq1_top_values", f"WITH {PROFILED}, {TOP_CTE} SELECT column_name, position, value, n, pct FROM top WHERE u <= 50 AND position <= 30")
def _(spark, d):
    return i.tidy(dq.top_values(profiled(spark, d)))


def _finding(issue, condition, detail):
    severity, remedy = dq.FINDINGS[issue]
    return (f"SELECT column_name, '{issue}' AS issue, {detail} AS detail, '{severity}' AS severity, "
            f"'{remedy.replace(chr(39), chr(39) * 2)}' AS remedy FROM prof LEFT JOIN first_value USING (column_name) WHERE {condition}")


HINTS = " OR ".join(f"column_name LIKE '%{h}%'" for h in dq.NUMERIC_HINTS)


@query("dq2_findings", f"WITH {PROFILE_CTE}, {TOP_CTE}, first_value AS (SELECT column_name, coalesce(value, 'nan') AS tv, pct AS tp FROM top WHERE u <= 50 AND position = 1) "
       + " UNION ALL ".join([
           _finding("High nulls", "null_pct > 20", "null_pct || '% missing'"),
           _finding("Moderate nulls", "null_pct > 5 AND null_pct <= 20", "null_pct || '% missing'"),
           _finding("Single value", "n_unique = 1", "'Only one unique value'"),
           _finding("Near-constant", "is_numeric AND std = 0", "'Standard deviation is zero'"),
           _finding("Potential outliers", "is_numeric AND p75 > p25 AND (max - p75 > 3 * (p75 - p25) OR p25 - min > 3 * (p75 - p25))", "'Values beyond 3*IQR from quartiles'"),
           _finding("High right skew", "is_numeric AND mean > 0 AND median > 0 AND mean / median > 2", "'mean/median = ' || round(mean / median, 2)"),
           _finding("High left skew", "is_numeric AND mean > 0 AND median > 0 AND median / mean > 2", "'median/mean = ' || round(median / mean, 2)"),
           _finding("Possible ID/free-text", "NOT is_numeric AND n_unique / n_rows::DOUBLE > 0.9", "'n_unique/n_rows > 0.9 (' || n_unique || '/' || n_rows || ')'"),
           _finding("Mis-typed numeric", f"NOT is_numeric AND n_unique <= 5 AND ({HINTS})", "'Non-numeric with ' || n_unique || ' uniques, name suggests numeric'"),
           _finding("Imbalanced categorical", "tp > 90", "'Top value ' || tv || ' at ' || tp || '%'"),
       ]))
def _(spark, d):
    return dq.by_severity(dq.findings(profiled(spark, d)))


@query("dq3_returns_describe", f"WITH {BASE}, r AS (SELECT quantity, net_sales::DOUBLE AS net_sales, discount FROM base WHERE document_type = 'return') "
       + describe_sql("r", ["quantity", "net_sales", "discount"]))
def _(spark, d):
    rows = i.sales(spark, d).where("document_type = 'return'").select("quantity", F.col("net_sales").cast("double").alias("net_sales"), "discount")
    return r4(describe(rows, ["quantity", "net_sales", "discount"]), ("min", "max"))


@query("dq4_missing_months", f"WITH {BASE} "
       "SELECT year_month FROM spine WHERE year_month NOT IN (SELECT year_month FROM base)")
def _(spark, d):
    return dq.missing_months(facts.with_month(i.sales(spark, d)))


@query("dq5_calendar_coverage", "SELECT m AS month_int FROM range(1, 13) t(m) WHERE m NOT IN "
       "(SELECT month(o_orderdate) FROM orders JOIN lineitem ON l_orderkey = o_orderkey)")
def _(spark, d):
    return i.tidy(dq.missing_calendar_months(i.sales(spark, d)))


@query("dq6_sign_violations", f"""WITH {BASE}, v AS (SELECT count(*) FILTER (WHERE document_type = 'return' AND quantity + 2 >= 0) AS quantity_violations,
 count(*) FILTER (WHERE document_type = 'return' AND net_sales >= 0) AS sales_violations FROM base)
SELECT *, quantity_violations + sales_violations = 0 AS passed FROM v""")
def _(spark, d):
    # two units are added to every line so that the smallest returns break the rule
    return dq.sign_violations(i.sales(spark, d).withColumn("quantity", F.col("quantity") + 2))


RATES = """CAST(coalesce(sum(quantity) FILTER (WHERE document_type = 'invoice'), 0) AS BIGINT) AS gross_qty,
 CAST(coalesce(sum(abs(quantity)) FILTER (WHERE document_type = 'return'), 0) AS BIGINT) AS return_qty,
 count(*) FILTER (WHERE document_type = 'invoice') AS n_invoices, count(*) FILTER (WHERE document_type = 'return') AS n_returns,
 round(sum(abs(quantity)) FILTER (WHERE document_type = 'return')::DOUBLE / sum(quantity) FILTER (WHERE document_type = 'invoice')::DOUBLE * 100, 6) AS return_rate_pct"""


@query("dq7_return_rate", f"WITH {BASE} SELECT {RATES} FROM base")
def _(spark, d):
    return i.tidy(dq.return_rates(i.sales(spark, d)))


@query("dq7_return_rate_by_year", f"WITH {BASE} SELECT left(year_month, 4)::BIGINT AS year, {RATES} FROM base GROUP BY 1")
def _(spark, d):
    return i.tidy(dq.return_rates(facts.with_month(i.sales(spark, d)), year_of(F.col("year_month"))))


@query("dq8_readiness", f"""WITH {BASE}, c AS (
 SELECT 'Product join match rate' AS check_name, count(product_category) * 100.0 / count(*) >= 98 AS passed, TRUE AS blocking FROM base UNION ALL
 SELECT 'Region join match rate', count(region) * 100.0 / count(*) >= 98, TRUE FROM base UNION ALL
 SELECT 'Unique item codes within product map', count(DISTINCT item_code) <= (SELECT count(*) FROM product), FALSE FROM base UNION ALL
 SELECT 'Unique territories within region map', count(DISTINCT territory_id) <= (SELECT count(*) FROM places), FALSE FROM base UNION ALL
 SELECT 'Missing full months', count(*) = 0, TRUE FROM spine WHERE year_month NOT IN (SELECT year_month FROM base) UNION ALL
 SELECT 'All 12 calendar months present', count(DISTINCT month(document_date)) = 12, FALSE FROM base UNION ALL
 SELECT 'Return sign convention', count(*) FILTER (WHERE document_type = 'return' AND (quantity >= 0 OR net_sales >= 0)) = 0, TRUE FROM base)
SELECT *, CASE WHEN (SELECT bool_and(passed OR NOT blocking) FROM c) THEN 'GO' ELSE 'NO-GO' END AS verdict FROM c""")
def _(spark, d):
    sales = i.sales(spark, d)
    checks = dq.readiness_checks(sales, facts.with_month(sales), i.product(spark, d), i.region(spark, d))
    return dq.readiness(checks)


@query("dq9_null_shares", """WITH m AS (SELECT c.*, o.* FROM customer c LEFT JOIN orders o ON o_custkey = c_custkey)
SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS null_share FROM m"
    for c in ("c_custkey", "c_acctbal", "o_orderkey", "o_totalprice", "o_orderpriority")) + ") WHERE null_count > 0")
def _(spark, d):
    from stockloom.sources.adapter import table

    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    m = table(spark, d, "customer").join(orders, "c_custkey", "left")
    return i.tidy(dq.null_shares(m.select("c_custkey", "c_acctbal", "o_orderkey", "o_totalprice", "o_orderpriority")))


@query("dq10_cardinality", f"""WITH {BASE} SELECT 'item_code' AS key, count(DISTINCT item_code) AS n_fact, (SELECT count(*) FROM product) AS n_dimension,
 count(DISTINCT item_code) <= (SELECT count(*) FROM product) AS passed FROM base UNION ALL SELECT 'territory_id', count(DISTINCT territory_id), (SELECT count(*) FROM places), count(DISTINCT territory_id) <= (SELECT count(*) FROM places) FROM base""")
def _(spark, d):
    sales = i.sales(spark, d)
    return dq.cardinality_check(sales, i.product(spark, d), "item_code").unionByName(
        dq.cardinality_check(sales, i.region(spark, d), "territory_id"))
