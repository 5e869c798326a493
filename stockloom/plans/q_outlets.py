"""Outlet profiling, segmentation and sales potential."""

from pyspark.sql import functions as F

from stockloom.operators import facts, opportunity as op, outlets as seg
from stockloom.plans import inputs as i
from stockloom.plans.q_blocks import describe_sql, r4
from stockloom.plans.q_features import CLUSTERS, rule_clusters
from stockloom.plans.q_market import CHI_P, chi_sql
from stockloom.plans.q_temporal import pattern_sql, sku_patterns
from stockloom.plans.registry import query
from stockloom.plans.sqlparts import ACTIVITY, BASE, GRID, OUTLETS
from stockloom.sources.staging import stage


def outlets(spark, d):
    """The outlet feature table, written once: every operator here reads it several times."""
    return stage(i.outlets(spark, d))


ACTIVE = f"{OUTLETS}, act AS (SELECT * REPLACE (total_net_sales::DOUBLE AS total_net_sales) FROM outlets WHERE is_active)"


@query("os1_active_split", f"WITH {OUTLETS} SELECT CASE WHEN is_active THEN 'Active' ELSE 'Churned' END AS state, count(*) AS n_outlets, sum(total_net_sales)::DOUBLE AS total_net_sales FROM outlets GROUP BY 1")
def _(spark, d):
    return i.tidy(seg.active_split(i.outlets(spark, d)))


FEATURES = ["total_net_sales", "avg_txn_per_active_month", "avg_net_sales_per_txn", "momentum", "return_rate"]
K2 = """z AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
 (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM mom),
z2 AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS a FROM z),
z3 AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs, 1 + x * sqrt(2 / (a - 4)) AS den FROM z2),
z4 AS (SELECT *, (1 - 2 / (9 * a) - sign(den) * pow((1 - 2 / a) / abs(den), 1.0::DOUBLE / 3)) / sqrt(2 / (9 * a)) AS zk FROM z3)"""


@query("os2_normality", f"WITH {ACTIVE}, mom AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*)::DOUBLE AS n, avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5) AS g1, avg(pow({c} - m, 4)) / pow(avg(pow({c} - m, 2)), 2) AS b2 FROM act, (SELECT avg({c}) AS m FROM act)"
    for c in FEATURES) + f"), {K2} SELECT feature, round(g1, 4) AS skewness, round(zs * zs + zk * zk, 4) AS statistic, round(exp(-(zs * zs + zk * zk) / 2), 4) AS p_value, exp(-(zs * zs + zk * zk) / 2) > 0.05 AS is_normal FROM z4")
def _(spark, d):
    return r4(seg.normality(i.outlets(spark, d).where("is_active"), FEATURES))


def fence(c):
    return f"({c} < q1_{c} - 3 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 3 * (q3_{c} - q1_{c}))"


EDGES = "e AS (SELECT " + ", ".join(f"quantile_cont({c}::DOUBLE, 0.25) AS q1_{c}, quantile_cont({c}::DOUBLE, 0.75) AS q3_{c}" for c in seg.NUMERIC) + " FROM act)"
COUNTED = "fl AS (SELECT outlet_id, total_net_sales, " + " + ".join(f"{fence(c)}::INT" for c in seg.NUMERIC) + " AS outlier_count, " + ", ".join(f"{fence(c)} AS {c}_outlier" for c in seg.NUMERIC) + " FROM act, e)"


@query("os3_outlier_flags", f"WITH {ACTIVE}, {EDGES}, {COUNTED} SELECT outlet_id, outlier_count::BIGINT AS outlier_count, " + ", ".join(f"{c}_outlier" for c in seg.NUMERIC) + " FROM fl")
def _(spark, d):
    flagged = seg.iqr_flags(outlets(spark, d).where("is_active"))
    return i.tidy(flagged.select("outlet_id", "outlier_count", *[f"{c}_outlier" for c in seg.NUMERIC]))


@query("os3_structural_share", f"WITH {ACTIVE}, {EDGES}, {COUNTED} SELECT count(*) AS n_outlets, count(*) FILTER (WHERE outlier_count >= 3) AS n_structural, round(coalesce(sum(total_net_sales) FILTER (WHERE outlier_count >= 3), 0) / sum(total_net_sales), 6) AS revenue_share FROM fl")
def _(spark, d):
    return i.tidy(seg.structural_share(seg.iqr_flags(outlets(spark, d).where("is_active"))))


CALM = f"{ACTIVE}, {EDGES}, {COUNTED}, calm AS (SELECT act.* FROM act JOIN fl USING (outlet_id) WHERE fl.outlier_count < 3)"


def calm(spark, d):
    """Active outlets that are no structural outliers."""
    return seg.calm_outlets(outlets(spark, d).where("is_active"))


LOGS = ", ".join(f"round(ln(1 + greatest({c}::DOUBLE, 0)), 6) AS {c}_log" for c in seg.LOGGED)


@query("os4_transforms", f"WITH {CALM} SELECT outlet_id, {LOGS}, round(least(greatest(momentum, lo), hi), 6) AS momentum_winsor FROM calm, (SELECT quantile_cont(momentum, 0.01) AS lo, quantile_cont(momentum, 0.99) AS hi FROM calm)")
def _(spark, d):
    out = seg.transform(calm(spark, d))
    return i.tidy(out.select("outlet_id", *[f"{c}_log" for c in seg.LOGGED], "momentum_winsor"))


def skew_sql(x):
    return f"(avg(pow({x}, 3)) - 3 * avg({x}) * avg(pow({x}, 2)) + 2 * pow(avg({x}), 3)) / pow(avg(pow({x}, 2)) - pow(avg({x}), 2), 1.5)"


@query("os4_skew_change", f"WITH {CALM}, tr AS (SELECT *, " + ", ".join(f"ln(1 + greatest({c}::DOUBLE, 0)) AS {c}_log" for c in seg.LOGGED)
       + ", least(greatest(momentum, lo), hi) AS momentum_winsor FROM calm, (SELECT quantile_cont(momentum, 0.01) AS lo, quantile_cont(momentum, 0.99) AS hi FROM calm)) "
       + " UNION ALL ".join(f"SELECT '{a}' AS feature, round({skew_sql(a + '::DOUBLE')}, 3) AS skew_before, round({skew_sql(b)}, 3) AS skew_after FROM tr"
                            for a, b in [*[(c, f"{c}_log") for c in seg.LOGGED], ("momentum", "momentum_winsor")]))
def _(spark, d):
    out = seg.skew_change(seg.transform(calm(spark, d)))
    return out.select("feature", F.round("skew_before", 3).alias("skew_before"), F.round("skew_after", 3).alias("skew_after"))


VIF_INPUT = [*[f"{c}_log" for c in seg.LOGGED], "active_months", "loyalty_ratio", "avg_txn_per_active_month", "n_unique_skus",
             "n_unique_categories", "return_rate", "recency_months", "momentum_winsor", "pct_cash_txn"]


@query("os5_variance_inflation")
def _(spark, d):
    kept, dropped = seg.drop_collinear(seg.transform(calm(spark, d)), VIF_INPUT)
    rows = [(c, float(v), True) for c, v in kept.items()] + [(c, None, False) for c in dropped]
    return spark.createDataFrame(rows, "feature string, vif double, kept boolean")


SCALED = ["avg_txn_per_active_month", "n_unique_skus", "return_rate", "momentum"]


@query("os6_standardised", f"WITH {ACTIVE} SELECT outlet_id, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM act)) / (SELECT stddev_pop({c}) FROM act), 6) AS {c}" for c in SCALED) + " FROM act")
def _(spark, d):
    return i.tidy(seg.standardise(outlets(spark, d).where("is_active").select("outlet_id", *SCALED), SCALED))


@query("os6_scaling_check", " UNION ALL ".join(f"SELECT '{c}' AS feature, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS std" for c in SCALED))
def _(spark, d):
    from stockloom.operators.ordering import long_values

    scaled = seg.standardise(outlets(spark, d).where("is_active").select("outlet_id", *SCALED), SCALED)
    out = long_values(scaled, SCALED).groupBy("feature").agg(F.abs(F.round(F.avg("value"), 6)).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))
    return out


POWER = f"{ACTIVE}, hi AS (SELECT quantile_cont(total_net_sales, 0.75) + 3 * (quantile_cont(total_net_sales, 0.75) - quantile_cont(total_net_sales, 0.25)) AS hi FROM act), sp AS (SELECT outlet_id, total_net_sales, CASE WHEN NOT is_active THEN 'Churned' WHEN total_net_sales::DOUBLE > hi THEN 'Power' ELSE 'Mainstream' END AS segment FROM outlets, hi)"


@query("os7_power_outlets", f"WITH {POWER} SELECT outlet_id, segment FROM sp")
def _(spark, d):
    return seg.power_split(outlets(spark, d)).select("outlet_id", "segment")


@query("os7_segment_shares", f"WITH {POWER} SELECT segment, count(*) AS n_outlets, sum(total_net_sales)::DOUBLE AS total_net_sales, round(sum(total_net_sales)::DOUBLE / (SELECT sum(total_net_sales) FROM sp)::DOUBLE, 6) AS revenue_share FROM sp GROUP BY 1")
def _(spark, d):
    return i.tidy(seg.segment_shares(seg.power_split(outlets(spark, d))))


CLUSTER_IN = f"""{POWER}, ms AS (SELECT o.*, ln(1 + o.avg_net_sales_per_txn) AS avg_net_sales_per_txn_log, ln(1 + o.avg_qty_per_txn) AS avg_qty_per_txn_log FROM outlets o JOIN sp USING (outlet_id) WHERE segment = 'Mainstream'),
mw AS (SELECT *, least(greatest(momentum, lo), hi) AS momentum_winsor FROM ms, (SELECT quantile_cont(momentum, 0.01) AS lo, quantile_cont(momentum, 0.99) AS hi FROM ms))"""


@query("os8_clustering_input", f"WITH {CLUSTER_IN} SELECT outlet_id, " + ", ".join(f"round(coalesce(({c} - (SELECT avg({c}) FROM mw)) / nullif((SELECT stddev_pop({c}) FROM mw), 0), 0), 5) AS {c}" for c in seg.CLUSTER_INPUT) + " FROM mw")
def _(spark, d):
    out = seg.clustering_input(seg.power_split(outlets(spark, d)).where("segment = 'Mainstream'"))
    return out.select("outlet_id", *[F.round(c, 5).alias(c) for c in seg.CLUSTER_INPUT])


def scaled_input(spark, d):
    table = outlets(spark, d)
    return stage(seg.clustering_input(seg.power_split(table).where("segment = 'Mainstream'"))), table


@query("os9_k_sweep")
def _(spark, d):
    return seg.k_sweep(scaled_input(spark, d)[0])


@query("os10_kmeans")
def _(spark, d):
    scaled, _table = scaled_input(spark, d)
    return seg.assign(seg.best_kmeans(scaled), scaled)


@query("os11_cluster_profile")
def _(spark, d):
    scaled, table = scaled_input(spark, d)
    return seg.cluster_profile(seg.assign(seg.best_kmeans(scaled), scaled), table, FEATURES)


@query("os11_cluster_by_region")
def _(spark, d):
    scaled, table = scaled_input(spark, d)
    regions = [r[0] for r in i.region(spark, d).select("region").distinct().orderBy("region").collect()]
    return seg.cluster_by_place(seg.assign(seg.best_kmeans(scaled), scaled), table, "region", regions)


@query("os12_segments")
def _(spark, d):
    return seg.segments(outlets(spark, d))


# -- potential ----------------------------------------------------------------

@query("x1_true_recency", f"WITH {ACTIVITY} SELECT outlet_id, date_diff('month', CAST(max(year_month) FILTER (WHERE n_invoices > 0) || '-01' AS DATE), CAST((SELECT max(year_month) FROM activity) || '-01' AS DATE))::DOUBLE AS recency_months FROM activity GROUP BY 1")
def _(spark, d):
    return facts.months_since_invoice(i.activity(spark, d)).withColumn("recency_months", F.col("recency_months").cast("double"))


@query("x1_active_per_territory", f"WITH {GRID} SELECT territory_id, year_month, count(DISTINCT outlet_id) AS n_active_outlets, count(DISTINCT item_code) AS n_active_skus FROM grid WHERE n_invoices > 0 GROUP BY 1, 2")
def _(spark, d):
    return op.active_per_territory(i.sparse_demand(spark, d))


@query("x2_share_of_territory", f"""WITH {GRID}, tt AS (SELECT territory_id, year_month, sum(net_quantity)::BIGINT AS tq FROM grid GROUP BY ALL)
SELECT outlet_id, item_code, territory_id, year_month, net_quantity, tq AS terr_net_quantity, round(net_quantity / (tq + 1e-8), 6) AS outlet_share_of_territory FROM grid JOIN tt USING (territory_id, year_month) WHERE n_invoices > 0 OR n_returns > 0""")
def _(spark, d):
    return i.tidy(op.share_of_territory(i.sparse_demand(spark, d)))


@query("x3_route_density", f"WITH {BASE} SELECT route_id, count(DISTINCT outlet_id) AS n_outlets, sum(quantity)::BIGINT AS quantity, sum(net_sales)::DOUBLE AS net_sales, round(sum(net_sales)::DOUBLE / count(DISTINCT outlet_id), 6) AS sales_per_outlet FROM base GROUP BY 1")
def _(spark, d):
    return i.tidy(op.route_density(i.sales(spark, d)))


@query("x4_spearman", f"""WITH {BASE}, tr AS (SELECT territory_id, count(DISTINCT outlet_id) AS a, sum(net_sales) AS b FROM base GROUP BY 1),
rk AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM tr)
SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM rk""")
def _(spark, d):
    sums = i.sales(spark, d).groupBy("territory_id").agg(F.countDistinct("outlet_id").alias("n_outlets"), F.sum("net_sales").alias("net_sales"))
    return i.tidy(op.spearman(stage(sums), "n_outlets", "net_sales"))


@query("x5_safety_stock", f"WITH {pattern_sql('item_code')} SELECT item_code, round(cv * mean_active_qty, 4) AS sigma, round(cv * mean_active_qty * 1.65, 4) AS safety_stock FROM pat")
def _(spark, d):
    return r4(op.safety_stock(sku_patterns(spark, d)))


def tier_sql(group, source="co"):
    return f"CASE WHEN coalesce((row_number() OVER g - 1) / nullif(count(*) OVER (PARTITION BY {group}) - 1, 0)::DOUBLE, 0) <= 0.3 THEN 'Top' WHEN coalesce((row_number() OVER g - 1) / nullif(count(*) OVER (PARTITION BY {group}) - 1, 0)::DOUBLE, 0) <= 0.9 THEN 'Middle' ELSE 'Bottom' END AS tier FROM {source} WINDOW g AS (PARTITION BY {group} ORDER BY total_net_sales DESC, outlet_id)"


TIERED = f"""{CLUSTERS}, co AS (SELECT o.* REPLACE (o.total_net_sales::DOUBLE AS total_net_sales), cluster_definition FROM outlets o JOIN clusters USING (outlet_id) WHERE cluster_definition <> 'Churned'),
ti AS (SELECT *, {tier_sql('cluster_definition')}), ceil_c AS (SELECT cluster_definition, quantile_cont(total_net_sales, 0.5) AS ceiling FROM ti WHERE tier = 'Top' GROUP BY 1),
up AS (SELECT outlet_id, cluster_definition, tier, total_net_sales, ceiling, ceiling - total_net_sales AS uplift, (ceiling - total_net_sales) / nullif(total_net_sales, 0) * 100 AS gap_pct FROM ti JOIN ceil_c USING (cluster_definition) WHERE tier <> 'Top')"""


def clustered(spark, d):
    table = outlets(spark, d)
    return stage(table.join(rule_clusters(table), "outlet_id").where("cluster_definition <> 'Churned'"))


@query("x6_tiers", f"WITH {TIERED} SELECT outlet_id, cluster_definition, tier FROM ti")
def _(spark, d):
    return op.tiers(clustered(spark, d)).select("outlet_id", "cluster_definition", "tier")


@query("x6_tier_profile", f"WITH {TIERED} " + " UNION ALL ".join(
    f"SELECT cluster_definition, tier, '{c}' AS feature, count({c}) AS n, round(avg({c}::DOUBLE), 6) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median FROM ti GROUP BY 1, 2" for c in op.PROFILE))
def _(spark, d):
    return i.tidy(op.tier_profile(op.tiers(clustered(spark, d))))


@query("x7_uplift", f"WITH {TIERED} SELECT outlet_id, cluster_definition, tier, round(total_net_sales, 6) AS total_net_sales, round(ceiling, 6) AS ceiling, round(uplift, 6) AS uplift, round(gap_pct, 6) AS gap_pct FROM up")
def _(spark, d):
    return i.tidy(op.uplift(op.tiers(clustered(spark, d))))


@query("x7_uplift_totals", f"WITH {TIERED} SELECT cluster_definition, count(*) AS n_outlets, round(sum(uplift), 2) AS total_uplift FROM up GROUP BY 1")
def _(spark, d):
    out = op.uplift_totals(op.uplift(op.tiers(clustered(spark, d))))
    return out.withColumn("total_uplift", F.round("total_uplift", 2))


@query("x7_cluster_and_region_gap", f"""WITH {TIERED}, tr AS (SELECT *, {tier_sql('region')}), ceil_r AS (SELECT region, quantile_cont(total_net_sales, 0.5) AS ceiling FROM tr WHERE tier = 'Top' GROUP BY 1)
SELECT u.outlet_id, round(uplift, 6) AS cluster_gap, round(r.ceiling - co.total_net_sales, 6) AS region_gap, CASE WHEN uplift < r.ceiling - co.total_net_sales THEN 'below peers' ELSE 'region ceiling' END AS signal
FROM up u JOIN co ON co.outlet_id = u.outlet_id JOIN ceil_r r ON r.region = co.region""")
def _(spark, d):
    return i.tidy(op.cluster_and_region_gap(clustered(spark, d)))


@query("x8_mann_whitney", f"""WITH {TIERED}, tb AS (SELECT cluster_definition, total_net_sales AS v, tier = 'Top' AS a FROM ti WHERE tier <> 'Middle'),
rk AS (SELECT *, rank() OVER (PARTITION BY cluster_definition ORDER BY v) + (count(*) OVER (PARTITION BY cluster_definition, v) - 1) / 2.0::DOUBLE AS r FROM tb)
SELECT cluster_definition, count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE NOT a) AS n2, round(sum(r) FILTER (WHERE a) - count(*) FILTER (WHERE a) * (count(*) FILTER (WHERE a) + 1) / 2.0::DOUBLE, 4) AS u FROM rk GROUP BY 1""")
def _(spark, d):
    rows = op.tiers(clustered(spark, d)).where("tier <> 'Middle'").withColumn("is_top", F.col("tier") == "Top")
    return r4(op.mann_whitney(rows, "total_net_sales", "is_top", ["cluster_definition"]).drop("z"))


@query("x10_cluster_statistics", f"WITH {TIERED}, ds AS (" + describe_sql("co", FEATURES, "cluster_definition") + ") SELECT cluster_definition, feature, n, mean, p50 AS median, std FROM ds")
def _(spark, d):
    return r4(op.cluster_statistics(clustered(spark, d), FEATURES))


@query("x10_cluster_independence", f"WITH {TIERED}, " + chi_sql("SELECT cluster_definition, region, count(*) AS n FROM co GROUP BY 1, 2", "cluster_definition", "region"))
def _(spark, d):
    return r4(op.cluster_independence(clustered(spark, d)).drop("p_value"))


@query("x10_cluster_independence_p", f"{CHI_P}(WITH {TIERED}, " + chi_sql("SELECT cluster_definition, region, count(*) AS n FROM co GROUP BY 1, 2", "cluster_definition", "region") + ")")
def _(spark, d):
    return r4(op.cluster_independence(clustered(spark, d)))
