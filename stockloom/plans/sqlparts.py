"""Shared SQL building blocks of the checks (plain WITH clauses)."""

LINES = """lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS document_number, CAST(o_orderdate AS DATE) AS document_date,
    strftime(o_orderdate, '%Y-%m') AS year_month, CAST(o_custkey AS VARCHAR) AS outlet_id,
    CAST(c_nationkey AS VARCHAR) AS territory_id,
    CASE WHEN l_returnflag = 'R' THEN 'return' ELSE 'invoice' END AS document_type,
    p_brand || '|' || p_type AS item_code, CAST(l_suppkey AS VARCHAR) AS route_id, o_orderpriority AS payment_term,
    CAST(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END
      AS DECIMAL(18,4)) AS net_sales,
    CAST(l_quantity AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS quantity, l_discount AS discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN part ON l_partkey = p_partkey)"""

PRODUCT = """product AS (
  SELECT DISTINCT p_brand || '|' || p_type AS item_code, p_type AS product_category, p_brand AS product_line,
    p_brand AS brand FROM part)"""

PLACES = """places AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS territory_id, r_name AS region, n_name AS district, r_name AS province
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

BASE = f"""{LINES}, {PRODUCT}, {PLACES},
base AS (SELECT l.*, p.product_category, p.product_line, p.brand, g.region, g.district, g.province
  FROM lines l LEFT JOIN product p USING (item_code) LEFT JOIN places g USING (territory_id)),
spine AS (SELECT strftime(m, '%Y-%m') AS year_month FROM (SELECT unnest(generate_series(
  CAST((SELECT min(year_month) FROM base) || '-01' AS DATE), CAST((SELECT max(year_month) FROM base) || '-01' AS DATE),
  INTERVAL 1 MONTH)) AS m))"""

MEASURES = """sum(quantity) AS net_quantity, sum(net_sales) AS net_sales,
  coalesce(sum(quantity) FILTER (WHERE quantity > 0), 0) AS gross_quantity,
  coalesce(sum(net_sales) FILTER (WHERE quantity > 0), 0) AS gross_sales,
  coalesce(sum(-quantity) FILTER (WHERE quantity < 0), 0) AS return_quantity,
  coalesce(sum(abs(net_sales)) FILTER (WHERE quantity < 0), 0) AS return_sales,
  count(*) FILTER (WHERE document_type = 'invoice') AS n_invoices,
  count(*) FILTER (WHERE document_type = 'return') AS n_returns"""

# zero-filled outlet x SKU x month grid
GRID = f"""{BASE},
pairs AS (SELECT DISTINCT outlet_id, item_code FROM base WHERE document_type = 'invoice'),
pair_sums AS (SELECT outlet_id, item_code, year_month, {MEASURES} FROM base GROUP BY ALL),
pair_dims AS (SELECT outlet_id, item_code, min(territory_id) AS territory_id FROM base GROUP BY ALL),
grid AS (SELECT outlet_id, item_code, year_month,
    CAST(coalesce(net_quantity, 0) AS BIGINT) AS net_quantity, coalesce(net_sales, 0) AS net_sales,
    CAST(coalesce(gross_quantity, 0) AS BIGINT) AS gross_quantity, coalesce(gross_sales, 0) AS gross_sales,
    CAST(coalesce(return_quantity, 0) AS BIGINT) AS return_quantity, coalesce(return_sales, 0) AS return_sales,
    coalesce(n_invoices, 0) AS n_invoices, coalesce(n_returns, 0) AS n_returns,
    territory_id, region, district, province, product_category, product_line, brand
  FROM pairs CROSS JOIN spine LEFT JOIN pair_sums USING (outlet_id, item_code, year_month)
    LEFT JOIN pair_dims USING (outlet_id, item_code) LEFT JOIN places USING (territory_id)
    LEFT JOIN product USING (item_code))"""

# zero-filled outlet x month table
ACTIVITY = f"""{BASE},
term_rank AS (SELECT outlet_id, year_month, payment_term, row_number() OVER (
    PARTITION BY outlet_id, year_month ORDER BY count(*) DESC, payment_term) AS pos
  FROM base WHERE payment_term IS NOT NULL GROUP BY outlet_id, year_month, payment_term),
outlet_sums AS (SELECT outlet_id, year_month, {MEASURES}, count(DISTINCT item_code) AS n_unique_skus,
  count(DISTINCT product_category) AS n_unique_categories FROM base GROUP BY ALL),
outlet_dims AS (SELECT outlet_id, min(territory_id) AS territory_id FROM base GROUP BY outlet_id),
activity AS (SELECT outlet_id, year_month, coalesce(n_invoices, 0) AS n_invoices,
    CAST(coalesce(gross_quantity, 0) AS BIGINT) AS gross_quantity, coalesce(gross_sales, 0) AS gross_sales,
    coalesce(n_returns, 0) AS n_returns, CAST(coalesce(return_quantity, 0) AS BIGINT) AS return_quantity,
    coalesce(return_sales, 0) AS return_sales, coalesce(n_unique_skus, 0) AS n_unique_skus,
    coalesce(n_unique_categories, 0) AS n_unique_categories, coalesce(payment_term, 'unknown') AS primary_payment_term,
    territory_id, region, district, province
  FROM outlet_dims CROSS JOIN spine LEFT JOIN outlet_sums USING (outlet_id, year_month)
    LEFT JOIN (SELECT * FROM term_rank WHERE pos = 1) USING (outlet_id, year_month)
    LEFT JOIN places USING (territory_id))"""

# one row per territory and month
TERRITORY = f"""{GRID},
terr_sums AS (SELECT year_month, territory_id, sum(net_quantity) AS net_quantity, sum(net_sales) AS net_sales,
    sum(gross_quantity) AS gross_quantity, sum(gross_sales) AS gross_sales, sum(return_quantity) AS return_quantity,
    sum(return_sales) AS return_sales, count(*) FILTER (WHERE n_invoices > 0) AS n_unique_skus,
    count(DISTINCT item_code) FILTER (WHERE n_invoices > 0) AS n_distinct_skus FROM grid GROUP BY ALL),
territory AS (SELECT territory_id, year_month, CAST(coalesce(net_quantity, 0) AS BIGINT) AS net_quantity,
    coalesce(net_sales, 0) AS net_sales, CAST(coalesce(gross_quantity, 0) AS BIGINT) AS gross_quantity,
    coalesce(gross_sales, 0) AS gross_sales, CAST(coalesce(return_quantity, 0) AS BIGINT) AS return_quantity,
    coalesce(return_sales, 0) AS return_sales, coalesce(n_unique_skus, 0) AS n_unique_skus,
    coalesce(n_distinct_skus, 0) AS n_distinct_skus, region, district, province
  FROM places CROSS JOIN (SELECT DISTINCT year_month FROM grid) LEFT JOIN terr_sums USING (territory_id, year_month))"""

CASH = "1-URGENT"

OUTLETS = f"""{ACTIVITY},
recent AS (SELECT *, row_number() OVER (PARTITION BY outlet_id ORDER BY year_month) AS pos,
    count(*) OVER (PARTITION BY outlet_id) AS cnt FROM activity
  WHERE year_month >= strftime(CAST((SELECT max(year_month) FROM activity) || '-01' AS DATE) - INTERVAL 11 MONTH, '%Y-%m')),
outlet_core AS (SELECT outlet_id, sum(gross_sales) AS total_net_sales, CAST(sum(gross_quantity) AS BIGINT) AS total_quantity,
    count(*) FILTER (WHERE n_invoices > 0) AS active_months,
    count(*) FILTER (WHERE n_invoices > 0) / 12.0::DOUBLE AS loyalty_ratio,
    coalesce(sum(n_invoices)::DOUBLE / nullif(count(*) FILTER (WHERE n_invoices > 0), 0), 0) AS avg_txn_per_active_month,
    coalesce(sum(gross_sales)::DOUBLE / nullif(count(*) FILTER (WHERE gross_sales > 0), 0), 0) AS avg_net_sales_per_txn,
    coalesce(sum(gross_quantity)::DOUBLE / nullif(count(*) FILTER (WHERE gross_quantity > 0), 0), 0) AS avg_qty_per_txn,
    max(n_unique_skus) AS n_unique_skus, max(n_unique_categories) AS n_unique_categories,
    coalesce(sum(n_returns)::DOUBLE / nullif(count(*) FILTER (WHERE n_returns > 0) + sum(n_returns), 0)::DOUBLE, 0) AS return_rate,
    CAST(0 AS BIGINT) AS recency_months,
    count(*) FILTER (WHERE primary_payment_term = '{CASH}') / count(*)::DOUBLE AS pct_cash_txn,
    CASE WHEN max(cnt) >= 6 AND sum(gross_sales) FILTER (WHERE pos <= cnt - 3) > 0
      THEN sum(gross_sales) FILTER (WHERE pos > cnt - 3)::DOUBLE / sum(gross_sales) FILTER (WHERE pos <= cnt - 3)::DOUBLE
      ELSE 0 END AS momentum
  FROM recent GROUP BY outlet_id),
outlets AS (SELECT outlet_core.*, active_months >= 1 AS is_active, territory_id, region, province
  FROM outlet_core JOIN outlet_dims USING (outlet_id) LEFT JOIN places USING (territory_id))"""


def chi2_p_sql(stat: str, dof: str) -> str:
    """The upper tail of a chi-square to four places, by the midpoint rule over t = x + v / (1 - v)."""
    t = f"({stat} / 2 + (k + 0.5) / 20000 / (1 - (k + 0.5) / 20000))"
    return f"""(SELECT round(sum(exp(({dof} / 2.0::DOUBLE - 1) * ln({t}) - {t} - lgamma({dof} / 2.0::DOUBLE)) / pow(1 - (k + 0.5) / 20000, 2)) / 20000, 4)
 FROM range(20000) AS r(k))"""


def f_p_sql(stat: str, d1: str, d2: str) -> str:
    """The upper tail of an F statistic to four places, by the midpoint rule over t = x u^2."""
    a, b, x = f"({d2} / 2.0::DOUBLE)", f"({d1} / 2.0::DOUBLE)", f"({d2}::DOUBLE / ({d2} + {d1} * {stat}))"
    u = "((k + 0.5) / 20000)"
    return f"""(SELECT round(sum(exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + ({a} - 1) * ln({x} * {u} * {u}) + ({b} - 1) * ln(1 - {x} * {u} * {u})) * 2 * {x} * {u}) / 20000, 4)
 FROM range(20000) AS r(k))"""
