"""Portfolio and geography."""

from pyspark.sql import functions as F

from stockloom.operators import geography as geo, portfolio as pf
from stockloom.plans import inputs as i
from stockloom.plans.q_blocks import r4
from stockloom.plans.registry import query
from stockloom.plans.sqlparts import BASE, GRID, TERRITORY, chi2_p_sql, f_p_sql

GRAINS = {"sku": "item_code", "brand": "brand", "line": "product_line", "category": "product_category"}


def ranked_sql(source, key):
    return f"""rev AS (SELECT {key}, sum(gross_sales) AS gs, sum(gross_quantity)::BIGINT AS gross_quantity FROM {source} GROUP BY 1),
ranked AS (SELECT {key}, gs::DOUBLE AS gross_sales, gross_quantity, gs::DOUBLE / (SELECT sum(gs)::DOUBLE FROM rev) AS share,
 (sum(gs) OVER (ORDER BY gs DESC, {key} ROWS UNBOUNDED PRECEDING))::DOUBLE / (SELECT sum(gs)::DOUBLE FROM rev) AS cumulative_share,
 row_number() OVER (ORDER BY gs DESC, {key}) AS rank FROM rev)"""


SEGMENT = "CASE WHEN cumulative_share <= 0.8 THEN 'Core' WHEN cumulative_share <= 0.95 THEN 'Growth' ELSE 'Long Tail' END"


def _pareto(name, grain):
    @query(f"pr1_pareto_{name}", f"WITH {GRID}, {ranked_sql('grid', grain)} SELECT {grain}, gross_sales, gross_quantity, round(share, 6) AS share, "
           f"round(cumulative_share, 6) AS cumulative_share, rank, {SEGMENT} AS pareto_segment FROM ranked")
    def _(spark, d):
        return i.tidy(pf.pareto(pf.revenue(i.sparse_demand(spark, d), grain), grain))


for _name, _grain in GRAINS.items():
    _pareto(_name, _grain)


@query("pr2_pareto_summary", f"WITH {GRID}, {ranked_sql('grid', 'item_code')} SELECT {SEGMENT} AS pareto_segment, count(*) AS n_skus, round(sum(gross_sales), 3) AS total_sales, "
       "round(sum(gross_sales) / (SELECT sum(gross_sales) FROM ranked) * 100, 2) AS pct_revenue FROM ranked GROUP BY 1")
def _(spark, d):
    out = pf.pareto_summary(pf.pareto(pf.revenue(i.sparse_demand(spark, d), "item_code"), "item_code"))
    return out.withColumn("total_sales", F.round(F.col("total_sales").cast("double"), 3))


@query("pr3_hhi", f"WITH {GRID} " + " UNION ALL ".join(
    f"SELECT '{g}' AS grain, round(sum(s * s) / pow(sum(s), 2), 6) AS hhi, sum(s * s) / pow(sum(s), 2) > 0.25 AS is_high FROM (SELECT sum(gross_sales)::DOUBLE AS s FROM grid GROUP BY {g})"
    for g in ("item_code", "product_line", "brand")))
def _(spark, d):
    demand = i.sparse_demand(spark, d)
    # one aggregation at SKU grain, coarser grains are rolled up from it
    sku = demand.groupBy("item_code", "product_line", "brand").agg(
        F.sum("gross_sales").alias("gross_sales"), F.sum("gross_quantity").alias("gross_quantity"))
    out = [pf.hhi(pf.revenue(sku, g), g) for g in ("item_code", "product_line", "brand")]
    return i.tidy(out[0].unionByName(out[1]).unionByName(out[2]))


CAGR = f"""{GRID}, y AS (SELECT product_line, left(year_month, 4)::INT AS year, sum(gross_sales) AS s FROM grid GROUP BY ALL),
a AS (SELECT product_line, arg_min(s, year)::DOUBLE AS f, arg_max(s, year)::DOUBLE AS l, (max(year) - min(year))::BIGINT AS n_years, sum(s)::DOUBLE AS total_sales FROM y GROUP BY 1),
g AS (SELECT product_line, n_years, total_sales, CASE WHEN f > 0 AND n_years > 0 THEN pow(l / f, 1.0::DOUBLE / n_years) - 1 ELSE 0 END AS cagr,
 total_sales / (SELECT sum(s)::DOUBLE FROM y) AS revenue_share FROM a)"""


@query("pr4_cagr", f"WITH {CAGR} SELECT product_line, n_years, total_sales, round(cagr, 6) AS cagr, round(revenue_share, 6) AS revenue_share FROM g")
def _(spark, d):
    return i.tidy(pf.cagr(i.sparse_full_years(spark, d)))


@query("pr5_quadrants", f"""WITH {CAGR}, m AS (SELECT quantile_cont(cagr, 0.5) AS mc, quantile_cont(revenue_share, 0.5) AS ms FROM g)
SELECT product_line, CASE WHEN cagr >= mc AND revenue_share >= ms THEN 'Protect & Invest' WHEN revenue_share >= ms THEN 'Defend' WHEN cagr >= mc THEN 'Nurture' ELSE 'Review/Exit' END AS quadrant FROM g, m""")
def _(spark, d):
    return pf.quadrants(pf.cagr(i.sparse_full_years(spark, d))).select("product_line", "quadrant")


def _mix(grain):
    @query(f"pr6_mix_{grain}", f"WITH {GRID}, y AS (SELECT {grain}, left(year_month, 4)::BIGINT AS year, sum(gross_quantity)::BIGINT AS gross_quantity FROM grid GROUP BY ALL) "
           f"SELECT {grain}, year, gross_quantity, round(gross_quantity::DOUBLE / sum(gross_quantity) OVER (PARTITION BY year)::DOUBLE, 6) AS share FROM y")
    def _(spark, d):
        return i.tidy(pf.mix_by_year(i.sparse_full_years(spark, d), grain).select(grain, "year", "gross_quantity", "share"))


_mix("product_category")
_mix("brand")


def _risk(grain):
    @query(f"pr7_return_risk_{grain}", f"""WITH {GRID}, s AS (SELECT {grain}, sum(return_quantity)::BIGINT AS return_quantity, sum(gross_quantity)::BIGINT AS gross_quantity,
 sum(n_returns)::BIGINT AS n_returns, sum(n_invoices)::BIGINT AS n_invoices FROM grid GROUP BY 1), r AS (SELECT *, return_quantity / ((return_quantity + gross_quantity)::DOUBLE + 1e-9) AS return_rate FROM s),
m AS (SELECT avg(return_rate) AS a, stddev_samp(return_rate) AS sd FROM r)
SELECT {grain}, return_quantity, gross_quantity, n_returns, n_invoices, round(return_rate, 6) AS return_rate, round((return_rate - a) / (sd + 1e-9), 4) AS z_score, (return_rate - a) / (sd + 1e-9) > 2 AS flag FROM r, m""")
    def _(spark, d):
        out = pf.return_risk(i.sparse_demand(spark, d), grain)
        return out.withColumns({"return_rate": F.round("return_rate", 6), "z_score": F.round("z_score", 4)})


_risk("product_category")
_risk("brand")


def chi_sql(cells, row, col):
    return f"""cells AS ({cells}), full_cells AS (SELECT r.{row}, c.{col}, coalesce(n, 0)::DOUBLE AS o, rt::DOUBLE * ct / (SELECT sum(n) FROM cells) AS e
 FROM (SELECT {row}, sum(n) AS rt FROM cells GROUP BY 1) r CROSS JOIN (SELECT {col}, sum(n) AS ct FROM cells GROUP BY 1) c LEFT JOIN cells USING ({row}, {col}))
SELECT round(sum(CASE WHEN dof = 1 THEN pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e ELSE (o - e) * (o - e) / e END), 4) AS chi2, max(dof)::BIGINT AS dof
 FROM full_cells, (SELECT (count(DISTINCT {row}) - 1) * (count(DISTINCT {col}) - 1) AS dof FROM full_cells)"""


@query("pr8_return_independence", f"WITH {GRID}, " + chi_sql(
    "SELECT product_category, 'invoice' AS kind, sum(n_invoices) AS n FROM grid GROUP BY 1 UNION ALL SELECT product_category, 'return', sum(n_returns) FROM grid GROUP BY 1", "product_category", "kind"))
def _(spark, d):
    return r4(pf.return_independence(i.sparse_demand(spark, d)).drop("p_value"))


@query("pr8_two_by_two", f"WITH {GRID}, " + chi_sql(
    "SELECT product_category = 'ECONOMY' AS big, 'invoice' AS kind, sum(n_invoices) AS n FROM grid GROUP BY 1 UNION ALL SELECT product_category = 'ECONOMY', 'return', sum(n_returns) FROM grid GROUP BY 1", "big", "kind"))
def _(spark, d):
    demand = i.sparse_demand(spark, d).withColumn("big", F.col("product_category") == "ECONOMY")
    return r4(pf.return_independence(demand, "big").drop("p_value"))


CHI_P = f"SELECT round(chi2, 4) AS chi2, dof, {chi2_p_sql('chi2', 'dof')} AS p_value FROM "


@query("pr8_return_independence_p", f"{CHI_P}(WITH {GRID}, " + chi_sql(
    "SELECT product_category, 'invoice' AS kind, sum(n_invoices) AS n FROM grid GROUP BY 1 UNION ALL SELECT product_category, 'return', sum(n_returns) FROM grid GROUP BY 1", "product_category", "kind") + ")")
def _(spark, d):
    return r4(pf.return_independence(i.sparse_demand(spark, d)))


CONT = f"""{GRID}, m AS (SELECT item_code, product_category, product_line, brand, year_month, sum(gross_quantity) AS q FROM grid GROUP BY ALL),
c AS (SELECT item_code, product_category, product_line, brand, count(*) FILTER (WHERE q > 0) AS active_months, count(*) AS n_months_available,
 count(*) FILTER (WHERE q > 0) / count(*)::DOUBLE AS activity_rate, coalesce(stddev_samp(q) FILTER (WHERE q > 0) / avg(q) FILTER (WHERE q > 0), 0) AS cv, sum(q)::BIGINT AS total_quantity FROM m GROUP BY ALL),
cont AS (SELECT *, CASE WHEN activity_rate >= 0.8 AND cv < 0.5 THEN 'Continuous' WHEN activity_rate < 0.2 OR cv > 1 THEN 'Lumpy' ELSE 'Intermittent' END AS demand_class FROM c)"""


def continuity(spark, d):
    return pf.sku_continuity(i.sparse_demand(spark, d), i.bounds(spark, d))


@query("pr9_sku_continuity", f"WITH {CONT} SELECT * REPLACE (round(activity_rate, 6) AS activity_rate, round(cv, 6) AS cv) FROM cont")
def _(spark, d):
    return i.tidy(continuity(spark, d))


@query("pr10_class_summary", f"WITH {CONT} SELECT demand_class, count(*) AS n_skus, sum(total_quantity)::BIGINT AS total_quantity, round(avg(cv), 6) AS mean_cv, round(avg(activity_rate), 6) AS mean_activity, "
       "round(count(*)::DOUBLE / (SELECT count(*) FROM cont) * 100, 1) AS pct_of_skus, round(sum(total_quantity)::DOUBLE / (SELECT sum(total_quantity) FROM cont)::DOUBLE * 100, 1) AS pct_of_volume FROM cont GROUP BY 1")
def _(spark, d):
    return i.tidy(pf.continuity_summary(continuity(spark, d)))


@query("pr11_category_by_class", f"WITH {CONT} SELECT product_category, " + ", ".join(
    f"count(*) FILTER (WHERE demand_class = '{c}') AS {c}" for c in ("Continuous", "Intermittent", "Lumpy")) + " FROM cont GROUP BY 1")
def _(spark, d):
    return pf.class_pivot(continuity(spark, d))


# -- geography ----------------------------------------------------------------

@query("ge1_province_revenue", f"WITH {TERRITORY}, {ranked_sql('territory', 'province')} SELECT province, gross_sales, gross_quantity, round(share, 6) AS share, round(cumulative_share, 6) AS cumulative_share, rank FROM ranked")
def _(spark, d):
    return i.tidy(geo.ranked_revenue(i.territories(spark, d), "province"))


@query("ge1_province_cr3", f"WITH {TERRITORY}, {ranked_sql('territory', 'province')} SELECT round(sum(share) FILTER (WHERE rank <= 3), 6) AS cr3, sum(share) FILTER (WHERE rank <= 3) > 0.6 AS is_high FROM ranked")
def _(spark, d):
    return i.tidy(geo.top_share(geo.ranked_revenue(i.territories(spark, d), "province")))


def gini_sql(key):
    return f"""r AS (SELECT {key}, s::DOUBLE AS s, row_number() OVER (ORDER BY s, {key}) AS pos, count(*) OVER () AS n FROM rev)
SELECT max(n) AS n, round(2 * sum(pos * s) / (max(n) * sum(s)) - (max(n) + 1) / max(n)::DOUBLE, 6) AS gini, round(sum(s) FILTER (WHERE pos > n - 3) / sum(s), 6) AS cr3 FROM r"""


@query("ge2_territory_gini", f"WITH {TERRITORY}, rev AS (SELECT territory_id, sum(gross_sales) AS s FROM territory GROUP BY 1), {gini_sql('territory_id')}")
def _(spark, d):
    return i.tidy(geo.gini(pf.revenue(i.territories(spark, d), "territory_id"), "territory_id"))


@query("ge2_outlet_gini", f"WITH {GRID}, rev AS (SELECT outlet_id, sum(gross_sales) AS s FROM grid GROUP BY 1), {gini_sql('outlet_id')}")
def _(spark, d):
    return i.tidy(geo.gini(pf.revenue(i.sparse_demand(spark, d), "outlet_id"), "outlet_id"))


@query("ge3_lorenz", f"WITH {TERRITORY}, rev AS (SELECT territory_id, sum(gross_sales) AS s FROM territory GROUP BY 1) SELECT territory_id, s::DOUBLE AS gross_sales, "
       "round((sum(s) OVER (ORDER BY s, territory_id ROWS UNBOUNDED PRECEDING))::DOUBLE / (sum(s) OVER ())::DOUBLE, 6) AS cumulative_share, round(row_number() OVER (ORDER BY s, territory_id) / (count(*) OVER ())::DOUBLE, 6) AS equality_line FROM rev")
def _(spark, d):
    return i.tidy(geo.lorenz(pf.revenue(i.territories(spark, d), "territory_id"), "territory_id").select("territory_id", "gross_sales", "cumulative_share", "equality_line"))


YEARS = f"""{TERRITORY}, yr AS (SELECT territory_id, region, province, left(year_month, 4)::BIGINT AS year, sum(gross_sales)::DOUBLE AS gross_sales FROM territory GROUP BY ALL),
yy AS (SELECT *, lag(gross_sales) OVER (PARTITION BY territory_id ORDER BY year) AS prev_year_sales FROM yr), yg AS (SELECT *, (gross_sales - prev_year_sales) / nullif(prev_year_sales, 0) AS yoy_growth FROM yy),
tg AS (SELECT territory_id, region, province, avg(yoy_growth) AS yoy_growth, sum(gross_sales) AS gross_sales FROM yg GROUP BY ALL)"""


@query("ge4_territory_years", f"WITH {YEARS} SELECT territory_id, region, province, year, gross_sales, prev_year_sales, round(yoy_growth, 6) AS yoy_growth FROM yg")
def _(spark, d):
    return i.tidy(geo.territory_years(i.territories(spark, d)))


@query("ge4_growth_extremes", f"""WITH {YEARS}, t5 AS (SELECT territory_id, region, province, round(yoy_growth, 6) AS yoy_growth, round(gross_sales, 3) AS gross_sales, 'top' AS side FROM tg ORDER BY tg.yoy_growth DESC, territory_id LIMIT 5),
b5 AS (SELECT territory_id, region, province, round(yoy_growth, 6) AS yoy_growth, round(gross_sales, 3) AS gross_sales, 'bottom' AS side FROM tg ORDER BY tg.yoy_growth, territory_id LIMIT 5) SELECT * FROM t5 UNION ALL SELECT * FROM b5""")
def _(spark, d):
    out = geo.growth_extremes(geo.territory_growth(geo.territory_years(i.territories(spark, d))))
    return out.withColumns({"yoy_growth": F.round("yoy_growth", 6), "gross_sales": F.round(F.col("gross_sales").cast("double"), 3)})


ANOVA = f"""{YEARS}, g AS (SELECT region, count(*) AS n, avg(gross_sales) AS m, var_pop(gross_sales) AS v FROM yr GROUP BY 1), a AS (SELECT sum(n * m) / sum(n) AS gm FROM g),
s AS (SELECT sum(n * (m - gm) * (m - gm)) AS b, sum(n * v) AS w, count(*) - 1 AS df_between, (sum(n) - count(*))::BIGINT AS df_within FROM g, a)"""


@query("ge5_region_anova", f"WITH {ANOVA} SELECT round((b / df_between) / (w / df_within), 6) AS f_stat, df_between, df_within FROM s")
def _(spark, d):
    years = geo.territory_years(i.territories(spark, d))
    return i.tidy(geo.one_way_anova(years, "region", "gross_sales").drop("p_value"))


@query("ge5_region_anova_p", f"""WITH {ANOVA}, t AS (SELECT (b / df_between) / (w / df_within) AS f_stat, df_between, df_within FROM s)
SELECT round(f_stat, 4) AS f_stat, df_between, df_within, {f_p_sql('f_stat', 'df_between', 'df_within')} AS p_value FROM t""")
def _(spark, d):
    return r4(geo.one_way_anova(geo.territory_years(i.territories(spark, d)), "region", "gross_sales"))


@query("ge6_payment_by_region", f"WITH {BASE} SELECT region, payment_term, sum(net_sales)::DOUBLE AS net_sales, sum(quantity)::BIGINT AS quantity, count(document_number) AS n_invoices FROM base GROUP BY 1, 2")
def _(spark, d):
    return i.tidy(geo.payment_by_region(i.base_sales(spark, d)))


@query("ge7_payment_independence", f"WITH {BASE}, " + chi_sql("SELECT region, payment_term, count(*) AS n FROM base GROUP BY 1, 2", "region", "payment_term"))
def _(spark, d):
    return r4(geo.payment_independence(geo.payment_by_region(i.base_sales(spark, d))).drop("p_value"))


@query("ge7_payment_mix", f"WITH {BASE} SELECT region, payment_term, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY region)::DOUBLE * 100, 6) AS pct FROM base GROUP BY 1, 2")
def _(spark, d):
    return i.tidy(geo.payment_mix(geo.payment_by_region(i.base_sales(spark, d))))
