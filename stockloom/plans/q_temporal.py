"""Temporal analytics over the national series, every SKU and every territory."""

from pyspark.sql import functions as F

from stockloom.operators import classify, facts, temporal as t
from stockloom.operators.relational import describe, histogram
from stockloom.plans import inputs as i
from stockloom.plans.q_blocks import describe_sql, r4
from stockloom.plans.registry import query
from stockloom.plans.sqlparts import BASE, GRID

KEYS = ["level", "series"]

SERIES = f"""{GRID}, series AS (
 SELECT 'national' AS level, 'all' AS series, year_month, sum(net_quantity)::BIGINT AS value FROM grid GROUP BY year_month UNION ALL
 SELECT 'sku', item_code, year_month, sum(net_quantity)::BIGINT FROM grid GROUP BY item_code, year_month UNION ALL
 SELECT 'territory', territory_id, year_month, sum(net_quantity)::BIGINT FROM grid GROUP BY territory_id, year_month)"""
W = "WINDOW w AS (PARTITION BY level, series ORDER BY year_month)"


def all_series(spark, d):
    """(level, series, year_month, value): national, per SKU and per territory, from one aggregation."""
    demand = i.sparse_demand(spark, d)
    names = (("national", F.lit("all")), ("sku", F.col("item_code")), ("territory", F.col("territory_id")))
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("level"), b.alias("series")) for a, b in names]))
    small = demand.groupBy("item_code", "territory_id", "year_month").agg(F.sum("net_quantity").alias("q"))
    summed = small.select(cells.alias("c"), "year_month", "q").groupBy("c.level", "c.series", "year_month").agg(F.sum("q").alias("value"))
    return facts.fill_months(summed, KEYS, i.bounds(spark, d), {"value": 0})


@query("tm1_moving_averages", f"""WITH {SERIES} SELECT level, series, year_month, value,
 CASE WHEN count(*) OVER a = 3 THEN round(avg(value) OVER a, 6) END AS ma3, CASE WHEN count(*) OVER b = 12 THEN round(avg(value) OVER b, 6) END AS ma12
 FROM series WINDOW a AS (PARTITION BY level, series ORDER BY year_month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING),
 b AS (PARTITION BY level, series ORDER BY year_month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)""")
def _(spark, d):
    return i.tidy(t.trend_and_growth(all_series(spark, d), KEYS).select(*KEYS, "year_month", "value", "ma3", "ma12"))


def change(n):
    return f"(value - lag(value, {n}) OVER w)::DOUBLE / nullif(lag(value, {n}) OVER w, 0)::DOUBLE * 100"


@query("tm2_growth_rates", f"WITH {SERIES} SELECT level, series, year_month, round({change(1)}, 6) AS mom_growth, round({change(12)}, 6) AS yoy_growth FROM series {W}")
def _(spark, d):
    return i.tidy(t.trend_and_growth(all_series(spark, d), KEYS).select(*KEYS, "year_month", "mom_growth", "yoy_growth"))


@query("tm2_growth_summary", f"""WITH {SERIES}, y AS (SELECT level, series, {change(12)} AS g FROM series {W})
SELECT level, series, round(avg(g), 4) AS mean_yoy, round(min(g), 4) AS min_yoy, round(max(g), 4) AS max_yoy, round(quantile_cont(g, 0.5), 4) AS median_yoy
FROM y WHERE g IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return r4(t.growth_summary(all_series(spark, d), KEYS))


PARTS = f"""{SERIES}, tr AS (SELECT *, right(year_month, 2)::INT AS m, CASE WHEN count(*) OVER f = 13 THEN
  (sum(value) OVER g + (lag(value, 6) OVER w + lead(value, 6) OVER w) / 2.0::DOUBLE) / 12 END AS trend FROM series
  WINDOW w AS (PARTITION BY level, series ORDER BY year_month), f AS (PARTITION BY level, series ORDER BY year_month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING),
  g AS (PARTITION BY level, series ORDER BY year_month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
sm AS (SELECT level, series, m, avg(value - trend) AS s FROM tr GROUP BY ALL),
sc AS (SELECT level, series, m, s - avg(s) OVER (PARTITION BY level, series) AS seasonal FROM sm),
parts AS (SELECT tr.*, seasonal, value - trend - seasonal AS resid FROM tr JOIN sc USING (level, series, m))"""


@query("tm3_decomposition", f"WITH {PARTS} SELECT level, series, year_month, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(resid, 6) AS resid FROM parts")
def _(spark, d):
    return i.tidy(t.decompose(all_series(spark, d), KEYS).select(*KEYS, "year_month", "trend", "seasonal", "resid"))


@query("tm3_seasonal_strength", f"""WITH {PARTS}, v AS (SELECT level, series, var_pop(seasonal) FILTER (WHERE resid IS NOT NULL) AS vs, var_pop(resid) AS vr FROM parts GROUP BY ALL)
SELECT level, series, round(vs / (vs + vr), 6) AS seasonal_strength, vs / (vs + vr) > 0.6 AS is_strong FROM v""")
def _(spark, d):
    return i.tidy(t.seasonal_strength(t.decompose(all_series(spark, d), KEYS), KEYS))


@query("tm3_robust_decomposition")
def _(spark, d):
    return i.tidy(t.decompose_robust(all_series(spark, d), KEYS).select(*KEYS, "year_month", "trend", "seasonal", "resid"))


@query("tm3_robust_strength")
def _(spark, d):
    return i.tidy(t.seasonal_strength(t.decompose_robust(all_series(spark, d), KEYS), KEYS))


@query("tm4_seasonal_index", f"""WITH {SERIES}, m AS (SELECT level, series, right(year_month, 2)::BIGINT AS month_int, avg(value) AS a FROM series GROUP BY ALL),
x AS (SELECT level, series, month_int, a / g AS ix FROM m JOIN (SELECT level, series, avg(value) AS g FROM series GROUP BY ALL) USING (level, series))
SELECT level, series, month_int, round(ix, 6) AS seasonal_index, row_number() OVER (PARTITION BY level, series ORDER BY ix DESC, month_int) = 1 AS is_peak,
 row_number() OVER (PARTITION BY level, series ORDER BY ix, month_int) = 1 AS is_trough FROM x""")
def _(spark, d):
    return i.tidy(t.seasonal_index(all_series(spark, d), KEYS))


@query("tm5_year_month_pivot", f"WITH {SERIES} SELECT level, series, left(year_month, 4)::BIGINT AS year, " + ", ".join(
    f"(sum(value) FILTER (WHERE right(year_month, 2) = '{m:02d}'))::DOUBLE AS m{m:02d}" for m in range(1, 13)) + " FROM series GROUP BY ALL")
def _(spark, d):
    out = t.year_month_pivot(all_series(spark, d), KEYS)
    return i.tidy(out.withColumns({f"m{m:02d}": F.col(f"m{m:02d}").cast("double") for m in range(1, 13)}))


def df_sql(source, prefix=""):
    return f"""(SELECT level, series, b / sqrt(greatest(syy - b * sxy, 0) / (n - 2) / sxx) AS {prefix}df_t FROM (SELECT level, series, count(*) AS n,
 regr_sxx(dy, y1) AS sxx, regr_syy(dy, y1) AS syy, regr_sxy(dy, y1) AS sxy, regr_sxy(dy, y1) / regr_sxx(dy, y1) AS b FROM (SELECT level, series,
 (value - lag(value) OVER w)::DOUBLE AS dy, (lag(value) OVER w)::DOUBLE AS y1 FROM {source} {W}) WHERE y1 IS NOT NULL GROUP BY ALL))"""


def kpss_sql(source, prefix="", lags=12):
    weights = " + ".join(f"2 * (1 - {k} / {lags + 1}.0::DOUBLE) * coalesce(sum(e * l{k}), 0)" for k in range(1, lags + 1))
    shifted = ", ".join(f"lag(e, {k}) OVER w AS l{k}" for k in range(1, lags + 1))
    return f"""(SELECT level, series, sum(s * s) / (count(*) * (sum(e * e) + {weights})) AS {prefix}kpss FROM (SELECT level, series, e, sum(e) OVER w AS s, {shifted}
 FROM (SELECT level, series, year_month, value - avg(value) OVER (PARTITION BY level, series) AS e FROM {source}) {W}) GROUP BY ALL)"""


DIFF = f"d1 AS (SELECT * FROM (SELECT level, series, year_month, value - lag(value) OVER w AS value FROM series {W}) WHERE value IS NOT NULL)"


@query("tm6_unit_root", f"WITH {SERIES}, {DIFF} SELECT 'level' AS form, level, series, round(df_t, 4) AS df_t, df_t < -2.86 AS df_stationary FROM {df_sql('series')} "
       f"UNION ALL SELECT 'diff', level, series, round(df_t, 4), df_t < -2.86 FROM {df_sql('d1')}")
def _(spark, d):
    s = all_series(spark, d)
    level = t.unit_root(s, KEYS).withColumn("form", F.lit("level"))
    return r4(level.unionByName(t.unit_root(t.differenced(s, KEYS), KEYS).withColumn("form", F.lit("diff"))))


@query("tm7_level_stationarity", f"WITH {SERIES}, {DIFF} SELECT 'level' AS form, level, series, round(kpss, 4) AS kpss, kpss < 0.463 AS kpss_stationary FROM {kpss_sql('series')} "
       f"UNION ALL SELECT 'diff', level, series, round(kpss, 4), kpss < 0.463 FROM {kpss_sql('d1')}")
def _(spark, d):
    s = all_series(spark, d)
    level = t.level_stationarity(s, KEYS).withColumn("form", F.lit("level"))
    return r4(level.unionByName(t.level_stationarity(t.differenced(s, KEYS), KEYS).withColumn("form", F.lit("diff"))))


def auto_kpss_sql(source):
    """KPSS by lists, with the window from the data."""
    product = lambda k: f"list_sum(list_transform(range(1, n - {k} + 1), lambda j: e[j] * e[j + {k}]))"
    return f"""(WITH v AS (SELECT level, series, list(value::DOUBLE ORDER BY year_month) AS a FROM {source} GROUP BY ALL),
 c AS (SELECT level, series, len(a) AS n, list_transform(a, lambda x: x - list_avg(a)) AS e FROM v),
 f AS (SELECT *, {product('0')} AS p0, list_transform(range(1, floor(pow(n, 2 / 9.0::DOUBLE))::BIGINT + 1), lambda k: {product('k')} / (n / 2)) AS cv FROM c),
 r AS (SELECT *, list_sum(list_transform(range(1, len(cv) + 1), lambda k: k * cv[k])) / nullif(p0 / n + list_sum(cv), 0) AS ra FROM f),
 w AS (SELECT *, least(coalesce(floor(1.1447::DOUBLE * pow(ra * ra, 1 / 3.0::DOUBLE) * pow(n, 1 / 3.0::DOUBLE)), 0), n - 1)::BIGINT AS lags FROM r)
 SELECT level, series, n::BIGINT AS n, lags, list_sum(list_transform(range(1, n + 1), lambda j: pow(list_sum(e[1:j]), 2)))
  / nullif(n * (p0 + coalesce(list_sum(list_transform(range(1, lags + 1), lambda k: 2 * (1 - k / (lags + 1.0::DOUBLE)) * {product('k')})), 0)), 0) AS kpss FROM w)"""


@query("tm7_level_stationarity_auto", f"WITH {SERIES}, {DIFF} SELECT 'level' AS form, level, series, n, lags, round(kpss, 4) AS kpss, kpss < 0.463 AS kpss_stationary FROM {auto_kpss_sql('series')} "
       f"UNION ALL SELECT 'diff', level, series, n, lags, round(kpss, 4), kpss < 0.463 FROM {auto_kpss_sql('d1')}")
def _(spark, d):
    s = all_series(spark, d)
    level = t.level_stationarity_auto(s, KEYS).withColumn("form", F.lit("level"))
    return r4(level.unionByName(t.level_stationarity_auto(t.differenced(s, KEYS), KEYS).withColumn("form", F.lit("diff"))))


@query("tm6_unit_root_auto")
def _(spark, d):
    s = all_series(spark, d)
    level = t.unit_root_auto(s, KEYS).withColumn("form", F.lit("level"))
    return r4(level.unionByName(t.unit_root_auto(t.differenced(s, KEYS), KEYS).withColumn("form", F.lit("diff"))))


@query("tm8_integration_order", f"""WITH {SERIES}, {DIFF} SELECT level, series, CASE WHEN d1_df_t < -2.86 AND d1_kpss < 0.463 THEN 'I(1)'
 WHEN df_t < -2.86 AND kpss < 0.463 THEN 'I(0)' ELSE 'conflict' END AS verdict FROM {df_sql('series')} JOIN {kpss_sql('series')} USING (level, series)
 JOIN {df_sql('d1', 'd1_')} USING (level, series) JOIN {kpss_sql('d1', 'd1_')} USING (level, series)""")
def _(spark, d):
    return t.integration_order(all_series(spark, d), KEYS).select(*KEYS, "verdict")


def acf_sql(lags):
    shifted = ", ".join(f"lag(e, {k}) OVER w AS l{k}" for k in range(1, lags + 1))
    sums = ", ".join(f"sum(e * l{k}) AS c{k}" for k in range(1, lags + 1))
    rows = " UNION ALL ".join(f"SELECT level, series, {k}::BIGINT AS lag, n, c{k} / v AS acf FROM c" for k in range(1, lags + 1))
    return f"""e AS (SELECT level, series, year_month, value - avg(value) OVER (PARTITION BY level, series) AS e FROM d1),
 c AS (SELECT level, series, count(*) AS n, sum(e * e) AS v, {sums} FROM (SELECT level, series, e, {shifted} FROM e {W}) GROUP BY ALL), acf AS ({rows})"""


@query("tm9_autocorrelation", f"WITH {SERIES}, {DIFF}, {acf_sql(36)} SELECT level, series, lag, n, round(acf, 6) AS acf FROM acf")
def _(spark, d):
    return i.tidy(t.autocorrelation(t.differenced(all_series(spark, d), KEYS), KEYS))


@query("tm10_partial_autocorrelation", f"""WITH RECURSIVE {SERIES}, {DIFF}, {acf_sql(36)},
 arr AS (SELECT level, series, list(acf ORDER BY lag) AS a FROM acf WHERE acf IS NOT NULL GROUP BY ALL),
 dl AS (SELECT level, series, a, 1 AS k, [a[1]] AS phi, a[1] AS p FROM arr
  UNION ALL SELECT level, series, a, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - nw * phi[k + 1 - j]), nw), nw
  FROM (SELECT *, (a[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * a[k + 1 - j]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * a[j]))) AS nw
   FROM dl WHERE k < len(a)))
SELECT level, series, k::BIGINT AS lag, round(p, 6) AS pacf FROM dl""")
def _(spark, d):
    acf = t.autocorrelation(t.differenced(all_series(spark, d), KEYS), KEYS)
    return i.tidy(t.partial_autocorrelation(acf, KEYS))


def tail_sql(q, dof):
    terms, fact = ["1.0"], 1
    for k in range(1, dof // 2):
        fact *= k
        terms.append(f"pow({q} / 2, {k}) / {fact}")
    return f"exp(-{q} / 2) * ({' + '.join(terms)})"


@query("tm11_ljung_box", f"""WITH {SERIES}, {DIFF}, {acf_sql(12)}, b AS (SELECT level, series, max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)) FILTER (WHERE lag <= 6) AS q6,
 max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)) AS q12 FROM acf GROUP BY ALL)
SELECT level, series, round(q6, 4) AS q_6, round(q12, 4) AS q_12, round({tail_sql('q6', 6)}, 4) AS p_6, round({tail_sql('q12', 12)}, 4) AS p_12 FROM b""")
def _(spark, d):
    acf = t.autocorrelation(t.differenced(all_series(spark, d), KEYS), KEYS, 12)
    return r4(t.ljung_box(acf, KEYS))


RATE = f"""{BASE}, rate AS (SELECT year_month, (sum(quantity) FILTER (WHERE document_type = 'invoice'))::BIGINT AS invoice_qty,
 (coalesce(sum(abs(quantity)) FILTER (WHERE document_type = 'return'), 0))::BIGINT AS return_qty, return_qty::DOUBLE / invoice_qty::DOUBLE AS return_rate
 FROM base GROUP BY 1 HAVING invoice_qty IS NOT NULL)"""


@query("tm12_monthly_return_rate", f"WITH {RATE} SELECT year_month, invoice_qty, return_qty, round(return_rate, 6) AS return_rate FROM rate")
def _(spark, d):
    return i.tidy(t.monthly_return_rate(facts.with_month(i.sales(spark, d))))


@query("tm12_return_anomalies", f"""WITH {RATE} SELECT year_month, invoice_qty, return_qty, round(return_rate, 6) AS return_rate, round(p95, 6) AS p95
 FROM rate, (SELECT quantile_cont(return_rate, 0.95) AS p95 FROM rate) WHERE return_rate > p95""")
def _(spark, d):
    return i.tidy(t.return_anomalies(t.monthly_return_rate(facts.with_month(i.sales(spark, d)))))


def pattern_sql(keys):
    return f"""{GRID}, s AS (SELECT {keys}, year_month, sum(net_quantity)::BIGINT AS q FROM grid GROUP BY ALL),
p AS (SELECT {keys}, count(*) FILTER (WHERE q > 0) AS active_months, sum(q)::BIGINT AS total_net_quantity, avg(q) FILTER (WHERE q > 0) AS mean_active_qty,
 count(*) FILTER (WHERE q > 0) / count(*)::DOUBLE AS active_frac, stddev_samp(q) / avg(q) FILTER (WHERE q > 0) AS cv,
 count(*)::DOUBLE / greatest(count(*) FILTER (WHERE q > 0), 1) AS demand_interval FROM s GROUP BY ALL),
pat AS (SELECT *, CASE WHEN active_frac >= 0.8 AND cv < 0.5 THEN 'Continuous' WHEN active_frac < 0.2 OR cv > 1.0 THEN 'Lumpy' ELSE 'Intermittent' END AS demand_class FROM p)"""


PATTERN_LIST = """active_months, total_net_quantity, round(mean_active_qty, 6) AS mean_active_qty, round(active_frac, 6) AS active_frac, round(cv, 6) AS cv,
 round(demand_interval, 6) AS demand_interval, demand_class"""


def sku_patterns(spark, d):
    return t.series_pattern(i.sparse_demand(spark, d), ["item_code"], classify.month_count(i.bounds(spark, d)))


@query("tm13_sku_pattern", f"WITH {pattern_sql('item_code')} SELECT item_code, {PATTERN_LIST} FROM pat")
def _(spark, d):
    return i.tidy(sku_patterns(spark, d))


@query("tm14_pair_pattern", f"WITH {pattern_sql('outlet_id, item_code')} SELECT outlet_id, item_code, {PATTERN_LIST} FROM pat")
def _(spark, d):
    return i.tidy(t.series_pattern(i.sparse_demand(spark, d), ["outlet_id", "item_code"], classify.month_count(i.bounds(spark, d))))


@query("tm14_pair_classes", f"WITH {pattern_sql('outlet_id, item_code')} SELECT demand_class, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 1) AS pct FROM pat GROUP BY 1")
def _(spark, d):
    pairs = t.series_pattern(i.sparse_demand(spark, d), ["outlet_id", "item_code"], classify.month_count(i.bounds(spark, d)))
    return t.class_shares(pairs)


TIER = "CASE WHEN cv IS NULL THEN 'N/A' WHEN cv < 0.3 THEN 'Low (<0.3)' WHEN cv < 0.6 THEN 'Medium (0.3–0.6)' ELSE 'High (>0.6)' END"


@query("tm15_cv_tiers", f"WITH {pattern_sql('item_code')} SELECT item_code, round(cv, 6) AS cv, {TIER} AS cv_tier FROM pat")
def _(spark, d):
    return i.tidy(sku_patterns(spark, d).select("item_code", "cv", t.cv_tier(F.col("cv")).alias("cv_tier")))


@query("tm15_cv_summary", f"WITH {pattern_sql('item_code')} SELECT round(quantile_cont(cv, 0.5), 6) AS cv_p50, round(quantile_cont(cv, 0.9), 6) AS cv_p90, round(avg(cv), 6) AS mean_cv, round(quantile_cont(cv, 0.9) / 0.3, 6) AS stock_multiple FROM pat")
def _(spark, d):
    return i.tidy(t.cv_summary(sku_patterns(spark, d)))


@query("tm15_tier_describe", f"WITH {pattern_sql('item_code')}, tp AS (SELECT {TIER} AS cv_tier, cv, active_frac, total_net_quantity FROM pat) "
       + describe_sql("tp", ["cv", "active_frac", "total_net_quantity"], "cv_tier").replace("min(cv)::DOUBLE AS min, max(cv)::DOUBLE AS max", "round(min(cv), 4) AS min, round(max(cv), 4) AS max"))
def _(spark, d):
    tiers = sku_patterns(spark, d).withColumn("cv_tier", t.cv_tier(F.col("cv")))
    return r4(describe(tiers, ["cv", "active_frac", "total_net_quantity"], ["cv_tier"]))


@query("tm15_cv_histogram", f"""WITH {pattern_sql('item_code')}, c AS (SELECT least(cv, 5) AS cv FROM pat), e AS (SELECT min(cv) AS lo, max(cv) AS hi FROM c)
SELECT least(floor((cv - lo) / ((hi - lo) / 40)), 39)::BIGINT AS bin, round(any_value(lo) + bin * any_value((hi - lo) / 40), 4) AS bin_start, count(*) AS n FROM c, e GROUP BY 1""")
def _(spark, d):
    clipped = sku_patterns(spark, d).select(F.least("cv", F.lit(5.0)).alias("cv"))
    edges = clipped.agg(F.min("cv").alias("lo"), F.max("cv").alias("hi"))
    return r4(histogram(clipped, "cv", 40, F.col("lo"), F.col("hi"), edges))
