"""Feature tables on the whole outlet x SKU x month grid, reported as digests per month and category."""

import math

from pyspark.sql import functions as F

from stockloom.operators import classify, facts, features as ft, outlets as seg, portfolio as pf, reduce as red
from stockloom.plans import inputs as i
from stockloom.plans.digest import digest, digest_sql
from stockloom.plans.q_market import CONT
from stockloom.plans.registry import query
from stockloom.plans.sqlparts import GRID, OUTLETS, TERRITORY
from stockloom.sources.staging import stage

START, END = "1995-01", "2000-12"
KEYS = ["year_month", "product_category"]
W = "WINDOW w AS (PARTITION BY outlet_id, item_code ORDER BY year_month)"


def frame(n):
    return f"OVER (PARTITION BY outlet_id, item_code ORDER BY year_month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lg(x):
    return f"CASE WHEN {x} > -1 THEN ln(1 + ({x})::DOUBLE) END"


def grid(spark, d):
    return i.full_demand(spark, d)


@query("ft1_seasonal_index", f"""WITH {GRID}, m AS (SELECT item_code, right(year_month, 2)::BIGINT AS month_int, avg(net_quantity) AS a FROM grid
 WHERE year_month BETWEEN '{START}' AND '{END}' GROUP BY ALL)
SELECT item_code, month_int, round(a / nullif(avg(a) OVER (PARTITION BY item_code), 0), 6) AS seasonal_index FROM m""")
def _(spark, d):
    """From the non-zero months and the pair counts; the grid is not built."""
    demand = i.sparse_demand(spark, d)
    pairs = demand.select(*facts.PAIR).distinct().groupBy("item_code").agg(F.count("*").alias("n_pairs"))
    return i.tidy(ft.seasonal_index_of_sparse(demand, pairs, START, END))


@query("ft1_seasonal_index_of_grid", f"""WITH {GRID}, m AS (SELECT item_code, right(year_month, 2)::BIGINT AS month_int, avg(net_quantity) AS a FROM grid
 WHERE year_month BETWEEN '{START}' AND '{END}' GROUP BY ALL)
SELECT item_code, month_int, round(a / nullif(avg(a) OVER (PARTITION BY item_code), 0), 6) AS seasonal_index FROM m""")
def _(spark, d):
    return i.tidy(ft.seasonal_index(grid(spark, d), START, END))


COLLAPSE, GROWTH = "Brand#3", "Brand#17"
SKU = f"""{CONT}, sku AS (SELECT item_code, demand_class, CASE demand_class WHEN 'Continuous' THEN 0 WHEN 'Intermittent' THEN 1 ELSE 2 END::BIGINT AS demand_class_encoded,
 activity_rate AS sku_activity_rate, cv AS sku_cv, (product_line = '{COLLAPSE}')::BIGINT AS is_structural_collapse, (product_line = '{GROWTH}')::BIGINT AS is_hyper_growth,
 ln(1 + total_quantity) AS sku_log_total_qty FROM cont)"""


def sku_lookup(spark, d):
    continuity = pf.sku_continuity(i.sparse_demand(spark, d), i.bounds(spark, d))
    classes = classify.classify(i.sku_stats(spark, d)).select("item_code", "demand_class")
    return ft.enriched_sku(continuity, classes, COLLAPSE, GROWTH)


@query("ft2_sku_lookup", f"WITH {SKU} SELECT * REPLACE (round(sku_activity_rate, 6) AS sku_activity_rate, round(sku_cv, 6) AS sku_cv, round(sku_log_total_qty, 6) AS sku_log_total_qty) FROM sku")
def _(spark, d):
    return i.tidy(sku_lookup(spark, d))


@query("ft3_territory_context", f"""WITH {TERRITORY} SELECT territory_id, year_month, net_quantity AS terr_net_quantity, net_sales::DOUBLE AS terr_net_sales,
 (lag(net_quantity) OVER w)::DOUBLE AS terr_lag_qty_1m, round(avg(net_quantity) OVER (PARTITION BY territory_id ORDER BY year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS terr_roll_mean_qty_3m
 FROM territory WINDOW w AS (PARTITION BY territory_id ORDER BY year_month)""")
def _(spark, d):
    out = ft.territory_context(i.territories(spark, d))
    return i.tidy(out.withColumn("terr_lag_qty_1m", F.col("terr_lag_qty_1m").cast("double")))


# Segments by rule: churned, power (3 IQR) and the rest split at the median of sales.
CLUSTERS = f"""{OUTLETS}, q AS (SELECT quantile_cont(total_net_sales::DOUBLE, 0.75) + 3 * (quantile_cont(total_net_sales::DOUBLE, 0.75) - quantile_cont(total_net_sales::DOUBLE, 0.25)) AS hi
 FROM outlets WHERE is_active), md AS (SELECT quantile_cont(total_net_sales::DOUBLE, 0.5) AS md FROM outlets, q WHERE is_active AND total_net_sales <= hi),
clusters AS (SELECT outlet_id, CASE WHEN NOT is_active THEN 'Churned' WHEN total_net_sales > hi THEN 'Power' WHEN total_net_sales >= md THEN 'High-Value Active'
 ELSE 'Low-Value Sporadic' END AS cluster_definition FROM outlets, q, md)"""


def rule_clusters(outlets):
    from stockloom.operators.ordering import quantiles

    split = seg.power_split(outlets)
    rest = split.where("segment = 'Mainstream'")
    mid = quantiles(rest, ["total_net_sales"], [0.5])
    name = (
        F.when(F.col("segment") != "Mainstream", F.col("segment"))
        .when(F.col("total_net_sales").cast("double") >= F.col("total_net_sales_p50"), "High-Value Active").otherwise("Low-Value Sporadic"))
    return split.crossJoin(F.broadcast(mid)).select("outlet_id", name.alias("cluster_definition"))


GRID_CLUSTERS = f"{GRID}, {CLUSTERS[CLUSTERS.index('term_rank AS'):]}"


@query("ft4_base_rows", f"""WITH {GRID_CLUSTERS} SELECT cluster_definition, year_month, count(*) AS n_rows, count(DISTINCT outlet_id) AS n_outlets, sum(net_quantity)::BIGINT AS net_quantity
 FROM grid JOIN clusters USING (outlet_id) WHERE year_month BETWEEN '{START}' AND '{END}' AND cluster_definition <> 'Churned' GROUP BY ALL""")
def _(spark, d):
    rows = ft.base_rows(grid(spark, d), stage(rule_clusters(stage(i.outlets(spark, d)))), START, END)
    per_outlet = rows.groupBy("cluster_definition", "year_month", "outlet_id").agg(F.count("*").alias("n"), F.sum("net_quantity").alias("q"))
    return per_outlet.groupBy("cluster_definition", "year_month").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_outlets"), F.sum("q").alias("net_quantity"))


TIME = {"year": False, "month_int": False, "months_elapsed": False, **{f"{f}_{k}": True for k in (1, 2, 3) for f in ("sin", "cos")}, "is_peak_month": False, "is_trough_month": False}
TIME_SQL = ("left(year_month, 4)::BIGINT AS year, right(year_month, 2)::BIGINT AS month_int, (left(year_month, 4)::BIGINT - 1995) * 12 + right(year_month, 2)::BIGINT AS months_elapsed, "
            + ", ".join(f"{f}({2 * math.pi * k!r} * right(year_month, 2)::BIGINT / 12) AS {f}_{k}" for k in (1, 2, 3) for f in ("sin", "cos"))
            + ", (right(year_month, 2) = '10')::INT AS is_peak_month, (right(year_month, 2) = '04')::INT AS is_trough_month")


@query("ft5_time_features", f"WITH {GRID}, f AS (SELECT year_month, product_category, {TIME_SQL} FROM grid) {digest_sql('f', KEYS, TIME)}")
def _(spark, d):
    return digest(ft.time_features(grid(spark, d), 1995), KEYS, list(TIME))


def mean_sales(n):
    return f"(sum(net_sales) {frame(n)})::DOUBLE / count(net_sales) {frame(n)}"


def std_sql(n):
    k, s, q = f"count(net_quantity) {frame(n)}", f"sum(net_quantity) {frame(n)}", f"sum(net_quantity * net_quantity) {frame(n)}"
    return f"CASE WHEN {k} > 1 THEN sqrt(({k} * {q} - {s} * {s})::DOUBLE / ({k} * ({k} - 1))::DOUBLE) END"


WINDOW_SQL = {
    **{f"lag_qty_{n}m": f"lag({lg('net_quantity')}, {n}) OVER w" for n in ft.LAGS},
    **{f"lag_sales_{n}m": f"lag({lg('net_sales')}, {n}) OVER w" for n in ft.LAGS},
    **{f"roll_mean_qty_{n}m": f"avg(net_quantity) {frame(n)}" for n in (3, 6, 12)},
    **{f"roll_std_qty_{n}m": std_sql(n) for n in (3, 6, 12)},
    **{f"roll_mean_sales_{n}m": mean_sales(n) for n in (3, 6, 12)},
    "roll_std_sales_6m": f"stddev_samp(net_sales::DOUBLE) {frame(6)}",
    **{f"roll_nonzero_count_{n}m": f"count(*) FILTER (WHERE net_quantity > 0) {frame(n)}" for n in (3, 6, 12)},
    **{f"roll_cv_qty_{n}m": f"({std_sql(n)}) / (avg(net_quantity) {frame(n)} + 1e-8)" for n in (3, 6, 12)},
    "yoy_growth": "(net_quantity - lag(net_quantity, 12) OVER w) / (lag(net_quantity, 12) OVER w + 1e-8)",
    "momentum_ratio": f"avg(net_quantity) {frame(3)} / (avg(net_quantity) {frame(6)} + 1e-8)",
    "short_long_ratio": f"avg(net_quantity) {frame(3)} / (avg(net_quantity) {frame(12)} + 1e-8)",
    "trend_slope_approx": "(lag(net_quantity, 1) OVER w - lag(net_quantity, 6) OVER w) / 5.0::DOUBLE",
    "current_return_rate": "return_quantity / (gross_quantity + return_quantity + 1e-8)",
    **{f"roll_return_rate_{n}m": f"sum(return_quantity) {frame(n)} / ((sum(gross_quantity + return_quantity) {frame(n)})::DOUBLE + 1e-8)" for n in (3, 6)},
    "price_per_unit": "net_sales::DOUBLE / greatest(net_quantity, 1)",
}
WHOLE = {f"roll_nonzero_count_{n}m" for n in (3, 6, 12)}


def window_query(name, columns, places=7):
    kinds = {c: c not in WHOLE for c in columns}
    exprs = ", ".join(f"{WINDOW_SQL[c]} AS {c}" for c in columns)

    @query(name, f"WITH {GRID}, f AS (SELECT year_month, product_category, {exprs} FROM grid {W}) {digest_sql('f', KEYS, kinds, places)}")
    def _(spark, d):
        return digest(ft.lag_rolling_features(grid(spark, d)), KEYS, columns, places)


window_query("ft6_lags", [f"lag_{x}_{n}m" for x in ("qty", "sales") for n in ft.LAGS])
window_query("ft7_rolling_mean_std", [*[f"roll_{s}_qty_{n}m" for s in ("mean", "std") for n in (3, 6, 12)], *[f"roll_mean_sales_{n}m" for n in (3, 6, 12)], "roll_std_sales_6m"])
window_query("ft8_rolling_nonzero_counts", [f"roll_nonzero_count_{n}m" for n in (3, 6, 12)])
window_query("ft9_ratios", [*[f"roll_cv_qty_{n}m" for n in (3, 6, 12)], "momentum_ratio", "short_long_ratio"])
window_query("ft10_growth_and_slope", ["yoy_growth", "trend_slope_approx"])
window_query("ft11_return_rates", ["current_return_rate", "roll_return_rate_3m", "roll_return_rate_6m"])
window_query("ft12_price", ["price_per_unit"], 10)

ZERO = f"""{GRID}, ev AS (SELECT outlet_id, item_code, year_month, product_category, net_quantity, (net_quantity > 0)::INT AS e, row_number() OVER w - 1 AS pos,
 sum((net_quantity > 0)::INT) OVER w AS run FROM grid {W}),
zero AS (SELECT outlet_id, item_code, year_month, product_category, pos - max(CASE WHEN e = 1 THEN pos END) OVER w AS months_since_last_purchase,
 CASE WHEN net_quantity = 0 THEN row_number() OVER (PARTITION BY outlet_id, item_code, run ORDER BY year_month) - 1 ELSE 0 END AS consecutive_zeros,
 avg(e) {frame(6)} AS demand_event_rate_6m, avg(e) {frame(12)} AS demand_event_rate_12m FROM ev {W})"""


def zero_query(name, kinds):
    @query(name, f"WITH {ZERO} {digest_sql('zero', KEYS, kinds)}")
    def _(spark, d):
        return digest(ft.add_zero_inflation(grid(spark, d)), KEYS, list(kinds))


zero_query("ft13_months_since_purchase", {"months_since_last_purchase": False})
zero_query("ft14_consecutive_zeros", {"consecutive_zeros": False})
zero_query("ft15_event_rates", {"demand_event_rate_6m": True, "demand_event_rate_12m": True})

RATES = {"ECONOMY": 0.1180, "STANDARD": 0.0916, "PROMO": 0.0832}
OUTLET_COLUMNS = {
    "outlet_total_net_sales_log": True, "outlet_active_months": False, "outlet_loyalty_ratio": True, "outlet_avg_net_sales_per_txn": True,
    "outlet_momentum": True, "outlet_n_unique_skus": False, "outlet_return_rate": True, "outlet_pct_cash_txn": True,
}
JOINED = f"""{GRID_CLUSTERS}, {SKU[SKU.index('m AS (SELECT item_code'):]},
sidx AS (SELECT item_code, month_int, a / nullif(avg(a) OVER (PARTITION BY item_code), 0) AS seasonal_index FROM (SELECT item_code, right(year_month, 2)::BIGINT AS month_int, avg(net_quantity) AS a
 FROM grid WHERE year_month BETWEEN '{START}' AND '{END}' GROUP BY ALL)),
br AS (SELECT g.outlet_id, g.item_code, year_month, g.product_category, cluster_definition, right(year_month, 2)::BIGINT AS month_int, {mean_sales(3)} / (avg(net_quantity) {frame(3)} + 1e-8) AS price_per_unit_roll_3m
 FROM grid g JOIN clusters USING (outlet_id) WHERE year_month BETWEEN '{START}' AND '{END}' AND cluster_definition <> 'Churned'),
j AS (SELECT br.year_month, br.product_category, price_per_unit_roll_3m, ln(1 + total_net_sales::DOUBLE) AS outlet_total_net_sales_log, active_months AS outlet_active_months, loyalty_ratio AS outlet_loyalty_ratio,
 avg_net_sales_per_txn AS outlet_avg_net_sales_per_txn, momentum AS outlet_momentum, n_unique_skus AS outlet_n_unique_skus, return_rate AS outlet_return_rate, pct_cash_txn AS outlet_pct_cash_txn,
 CASE cluster_definition WHEN 'Power' THEN 0 WHEN 'High-Value Active' THEN 1 ELSE 2 END AS cluster_encoded, (cluster_definition = 'Power')::INT AS is_power_outlet,
 (cluster_definition = 'High-Value Active')::INT AS is_high_value_active, (cluster_definition = 'Low-Value Sporadic')::INT AS is_low_value_sporadic,
 CASE br.product_category {' '.join(f"WHEN '{k}' THEN {v}" for k, v in RATES.items())} ELSE 0 END::DOUBLE AS category_return_rate,
 cluster_encoded * 3 + demand_class_encoded AS grid_cell, demand_class_encoded, seasonal_index
 FROM br LEFT JOIN outlets USING (outlet_id) LEFT JOIN sku USING (item_code) LEFT JOIN sidx USING (item_code, month_int))"""


def base_and_outlets(spark, d, carry=False):
    """Training rows with their segment, and the outlet features they were built from.

    Outlet features and segments are written first: small tables of known size,
    so Spark decides by their size whether to broadcast them to the grid. With ``carry`` the rows bring
    the outlet features along, joined before the months are filled.
    """
    outlets = stage(i.outlets(spark, d))
    rows = ft.base_grid(i.sparse_demand(spark, d), stage(rule_clusters(outlets)), i.bounds(spark, d), START, END, ft.outlet_columns(outlets) if carry else None)
    return ft.time_features(rows, 1995), outlets


def lookups(spark, d):
    """SKU and seasonal lookup tables, written once; the demand they share is written too."""
    demand = stage(i.sparse_demand(spark, d))
    bounds = i.bounds(spark, d)
    continuity = pf.sku_continuity(demand, bounds)
    stats = classify.activity_and_cv(facts.national_sku_demand(demand), classify.month_count(bounds))
    classes = classify.classify(stats).select("item_code", "demand_class")
    pairs = demand.select(*facts.PAIR).distinct().groupBy("item_code").agg(F.count("*").alias("n_pairs"))
    sku = ft.enriched_sku(continuity, classes, COLLAPSE, GROWTH)
    return stage(sku), stage(ft.seasonal_index_of_sparse(demand, pairs, START, END))


def joined(spark, d):
    rows, outlets = base_and_outlets(spark, d, carry=True)
    base = ft.lag_rolling_features(rows).withColumn("_category", F.col("product_category"))
    sku, seasonal = lookups(spark, d)
    brought = [c for c in ft.outlet_columns(outlets).columns if c != "outlet_id"]
    out = ft.join_features(base, None, sku, seasonal, RATES, ["_category", *brought])
    return out.withColumnRenamed("_category", "product_category")


def join_query(name, kinds):
    @query(name, f"WITH {JOINED} {digest_sql('j', KEYS, kinds)}")
    def _(spark, d):
        return digest(joined(spark, d), KEYS, list(kinds))


join_query("ft16_outlet_join", OUTLET_COLUMNS)
join_query("ft17_cluster_codes", {"cluster_encoded": False, "is_power_outlet": False, "is_high_value_active": False, "is_low_value_sporadic": False})
join_query("ft18_category_return_rate", {"category_return_rate": True})
join_query("ft19_grid_cell", {"grid_cell": False, "demand_class_encoded": False, "seasonal_index": True, "price_per_unit_roll_3m": True})

TARGET = {"target_qty_raw": False, "target_qty_log1p": True, "target_is_nonzero": False, "target_log1p_net_sales": True}


@query("ft20_targets", f"""WITH {GRID}, t AS (SELECT year_month, product_category, lead(net_quantity, 2) OVER w AS target_qty_raw, lead({lg('net_sales')}, 2) OVER w AS target_log1p_net_sales FROM grid {W}),
f AS (SELECT *, {lg('target_qty_raw')} AS target_qty_log1p, (target_qty_raw > 0)::INT AS target_is_nonzero FROM t) {digest_sql('f', KEYS, TARGET)}""")
def _(spark, d):
    return digest(ft.add_targets(grid(spark, d)), KEYS, list(TARGET))


# -- activity filter and matrix ----------------------------------------------

@query("mr1_activity_filter", f"""WITH {ZERO} SELECT year_month, count(*) AS rows_before, count(*) FILTER (WHERE demand_event_rate_6m > 0) AS rows_after FROM zero GROUP BY 1""")
def _(spark, d):
    return red.rows_by_month(ft.zero_inflation_features(grid(spark, d)))


MATRIX = {"net_quantity": False, "roll_mean_qty_6m": True, "lag_qty_1m": True, "months_since_last_purchase": False, "demand_event_rate_6m": True, "target_qty_raw": False, "sku_activity_rate": True, "seasonal_index": True}


@query("mr8_reduced_matrix", f"""WITH {JOINED}, ev AS (SELECT outlet_id, item_code, year_month, net_quantity, product_category, net_sales, (net_quantity > 0)::INT AS e, row_number() OVER w - 1 AS pos FROM grid
 WHERE year_month BETWEEN '{START}' AND '{END}' {W}),
mx AS (SELECT ev.*, right(year_month, 2)::BIGINT AS month_int, avg(net_quantity) {frame(6)} AS roll_mean_qty_6m, lag({lg('net_quantity')}, 1) OVER w AS lag_qty_1m, pos - max(CASE WHEN e = 1 THEN pos END) OVER w AS months_since_last_purchase,
 avg(e) {frame(6)} AS demand_event_rate_6m, lead(net_quantity, 2) OVER w AS target_qty_raw FROM ev {W}),
fm AS (SELECT mx.*, sku_activity_rate, seasonal_index FROM mx JOIN clusters USING (outlet_id) LEFT JOIN sku USING (item_code) LEFT JOIN sidx USING (item_code, month_int)
 WHERE demand_event_rate_6m > 0 AND cluster_definition <> 'Churned') {digest_sql('fm', KEYS, MATRIX)}""")
def _(spark, d):
    """Base, zero-inflation and target features from one window pass, then two lookups."""
    rows, _outlets = base_and_outlets(spark, d)
    wide = ft.add_targets(ft.add_zero_inflation(ft.lag_rolling_features(rows)))
    active = red.active_rows(wide)
    sku, seasonal = lookups(spark, d)
    out = active.join(sku, "item_code", "left").join(seasonal, ["item_code", "month_int"], "left")
    return digest(out, KEYS, list(MATRIX))
