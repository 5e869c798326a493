import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import geography, ordering as o, portfolio, relational as rel


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group and a third with one value."""
    rng = np.random.default_rng(1)
    rows = [(int(i), "hot" if i % 3 == 0 else f"g{i % 7}", 0 if i % 3 == 1 else int(rng.integers(-50, 50))) for i in range(900)]
    return spark.createDataFrame(rows, "id long, g string, v long"), rows


@pytest.mark.parametrize("ranges", [1, 5, 48])
def test_running_totals_match_a_plain_loop(skewed, ranges):
    df, rows = skewed
    out = o.running_totals(df, [F.col("v"), F.col("id")], {"run": F.col("v"), "pos": F.lit(1).cast("bigint")}, ["g"], ranges)
    want, seen = {}, {}
    for i, g, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        s, n = seen.get(g, (0, 0))
        seen[g] = want[i] = (s + v, n + 1)
    assert {r.id: (r.run, r.pos) for r in out.collect()} == want


def test_global_rank_has_no_gaps(skewed):
    df, rows = skewed
    out = o.global_rank(df, [(-F.col("v")).alias("n"), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, len(rows) + 1))
    assert [r.id for r in out] == [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))]


def test_quantiles_are_exact(skewed):
    df, rows = skewed
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = o.quantiles(df, ["v", "id"], probs).first()
    for c, at in (("v", 2), ("id", 0)):
        want = np.quantile([r[at] for r in rows], probs)
        assert np.allclose([got[f"{c}_p{round(p * 100):02d}"] for p in probs], want)


def test_grouped_quantiles(skewed):
    df, rows = skewed
    for r in o.quantiles(df, ["v"], [0.5], ["g"]).collect():
        assert r.v_p50 == np.median([x[2] for x in rows if x[1] == r.g])


def test_pareto_edges_and_ties(spark):
    df = spark.createDataFrame([("a", 80, 1), ("b", 15, 1), ("d", 2, 1), ("c", 2, 1), ("e", 1, 1)], "k string, gross_sales long, gross_quantity long")
    out = {r.k: r for r in portfolio.pareto(df, "k").collect()}
    assert (out["a"].pareto_segment, out["b"].pareto_segment, out["c"].pareto_segment) == ("Core", "Growth", "Long Tail")
    assert out["c"]["rank"] == 3 and out["d"]["rank"] == 4


def test_gini_bounds(spark):
    even = spark.createDataFrame([(str(i), 5) for i in range(8)], "t string, gross_sales long")
    one = spark.createDataFrame([(str(i), 10 if i == 3 else 0) for i in range(8)], "t string, gross_sales long")
    assert abs(geography.gini(even, "t").first().gini) < 1e-12
    assert geography.gini(one, "t").first().gini == pytest.approx(7 / 8)


def test_chi_square_with_empty_cells(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("c", "y", 5)], "r string, c string, n long")
    table = np.array([[10, 20], [30, 0], [0, 5.0]])
    e = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    got = portfolio.chi_square(cells, "r", "c", "n").first()
    assert got.chi2 == pytest.approx(((table - e) ** 2 / e).sum()) and got.dof == 2
    two = spark.createDataFrame([("a", "x", 10), ("b", "y", 20)], "r string, c string, n long")
    t = np.array([[10, 0], [0, 20.0]])
    e = t.sum(1, keepdims=True) * t.sum(0) / t.sum()
    assert portfolio.chi_square(two, "r", "c", "n").first().chi2 == pytest.approx(((np.abs(t - e) - 0.5) ** 2 / e).sum())


def test_match_rate_and_histogram(spark):
    fact = spark.createDataFrame([("a",)] * 97 + [("z",)] * 3, "k string")
    dim = spark.createDataFrame([("a",)], "k string")
    got = rel.match_rate(fact, dim, "k").first()
    assert got.match_pct == 97.0 and not got.passed
    assert [r.k for r in rel.orphans(fact, dim, "k").collect()] == ["z"]
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    edges = df.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    counts = {r.bin: r.n for r in rel.histogram(df, "x", 5, F.col("lo"), F.col("hi"), edges).collect()}
    assert counts == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}


def test_ranges_follow_the_rows_not_the_groups(spark):
    """64 groups, one with a third of the rows: no range is above twice the mean."""
    rows = spark.range(12000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 64).alias("g"), F.xxhash64("id").alias("v"), "id")
    ordered = o.running_totals(rows, [F.col("v"), F.col("id")], {"pos": F.lit(1).cast("bigint")}, ["g"], 500)
    assert ordered.groupBy("g").agg(F.max("pos").alias("top"), F.count("*").alias("n"), F.countDistinct("pos").alias("d")).where("top <> n or d <> n").count() == 0
    placed = rows.repartitionByRange(24, F.struct("g", "v", "id")).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in placed) <= 2 * 12000 / len(placed)


def quantile_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, n in (("a", 6000), ("b", 3), (None, 900), ("c", 1)):
        for _ in range(n):
            x = float(rng.normal())
            rows.append((g, x, float(rng.integers(0, 4)) if rng.random() > 0.2 else None, 0.0 if rng.random() < 0.8 else x))
    return rows, spark.createDataFrame([*rows, ("d", None, None, None)], "g string, x double, few double, zeros double")


@pytest.mark.parametrize("accuracy", [4000, 50])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_bracketed_quantiles_equal_numpy(spark, by, accuracy):
    rows, df = quantile_rows(spark)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    columns = ["x", "few", "zeros"]
    got = {(r.g if by else "all", r.feature, r.prob): (r.n, r.quantile) for r in o.quantiles_long(df, columns, probs, by, accuracy, few_rows=0).collect()}
    want = {}
    for k, c in enumerate(columns, 1):
        for g in {r[0] for r in rows} if by else {"all"}:
            v = [r[k] for r in rows if r[k] is not None and (not by or r[0] == g)]
            for p in probs if v else []:
                want[g, c, p] = (len(v), pytest.approx(float(np.quantile(v, p)), abs=1e-12))
    assert got == want
    sorted_way = {(r.g if by else "all", r.feature, r.prob): (r.n, r.quantile) for r in o.quantiles_by_order(df, columns, probs, by).collect()}
    assert sorted_way == got


def test_bracket_gathers_few_values(spark):
    df = spark.range(300_000).select((F.col("id") * 7919 % 300_007).cast("double").alias("x"), F.lit(1.0).alias("one"))
    out = o.quantiles_long(df, ["x", "one"], [0.5, 0.99])
    assert {(r.feature, r.prob): r.quantile for r in out.collect()} == {k: v for k, v in {
        ("x", p): float(np.quantile([i * 7919 % 300_007 for i in range(300_000)], p)) for p in (0.5, 0.99)}.items()} | {("one", 0.5): 1.0, ("one", 0.99): 1.0}
