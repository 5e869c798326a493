import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.functions import stats
from stockloom.operators import metrics as mt, modeling as ml, reduce as red


def plain_chi2_tail(stat, dof):
    half, odd = stat / 2, dof % 2
    tail = math.erfc(math.sqrt(half)) if odd else 0.0
    return tail + sum(math.exp((k + 0.5 * odd) * math.log(half) - half - math.lgamma(k + 0.5 * odd + 1)) for k in range(dof // 2))


def plain_f_tail(stat, d1, d2, steps=400_000):
    x, a, b = d2 / (d2 + d1 * stat), d2 / 2, d1 / 2
    u = (np.arange(steps) + 0.5) / steps
    t = x * u * u
    return float((np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * np.log(t) + (b - 1) * np.log1p(-t)) * 2 * x * u).mean())


def test_tail_probabilities(spark):
    rows = [(s * d, float(d), float(d2)) for d in (1, 2, 3, 7, 40, 301) for d2 in (1, 4, 25, 600) for s in (0.2, 0.9, 1.0, 1.3, 3.0)]
    df = spark.createDataFrame(rows, "x double, d double, d2 double")
    for r in df.select("*", stats.chi2_p("x", "d").alias("c"), stats.f_p(F.col("x") / F.col("d"), "d", "d2").alias("f")).collect():
        assert r.c == pytest.approx(plain_chi2_tail(r.x, int(r.d)), rel=1e-8, abs=1e-13)
        assert r.f == pytest.approx(plain_f_tail(r.x / r.d, r.d, r.d2), rel=2e-4, abs=1e-7)
    known = spark.createDataFrame([(3.841458820694124, 1.0, 4.964602743730711, 10.0), (12.591587243743977, 6.0, None, 1.0), (float("nan"), 2.0, float("nan"), 2.0), (0.0, 2.0, 0.0, 3.0), (1.0, 0.0, 1.0, None)],
                                  "x double, d double, f double, d2 double")
    got = known.select(stats.chi2_p("x", "d"), stats.f_p("f", "d", "d2")).collect()
    assert got[0] == (pytest.approx(0.05), pytest.approx(0.05)) and got[1][0] == pytest.approx(0.05)
    assert got[1][1] is None and tuple(got[2]) == (None, None) and tuple(got[3]) == (1.0, 1.0) and tuple(got[4]) == (None, None)


def test_month_folds_expand():
    months = [f"m{i:02d}" for i in range(13)]
    assert ml.month_folds(months, 3) == [("m03", "m04", "m06"), ("m06", "m07", "m09"), ("m09", "m10", "m12")]
    with pytest.raises(ValueError):
        ml.month_folds(months[:3], 3)


def test_sampled_settings_are_distinct():
    picks = ml.sample_settings({"a": [1, 2], "b": [1, 2, 3]}, 100, 1)
    assert len({tuple(sorted(p.items())) for p in picks}) == 6


def test_metrics_on_zero_actuals(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0)], "y double, p double")
    row = mt.regression_metrics(df, "y", "p").first()
    assert row.mape == 0.0 and row.zero_fraction == 1.0


def test_auc_with_ties_and_confusion(spark):
    rng = np.random.default_rng(5)
    s, y = rng.integers(0, 6, 200), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    wins = sum((a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0])
    assert mt.auc(df, "y", "s").first().auc == pytest.approx(wins / ((y == 1).sum() * (y == 0).sum()))
    c = mt.classification_metrics(df, "y", "s", 3).first()
    assert c.tp + c.fp + c.fn + c.tn == 200 and c.tp == int(((s >= 3) & (y == 1)).sum())


def test_greedy_drop_leaves_no_pair():
    corr = np.array([[1, .9, .85, .1], [.9, 1, .2, .1], [.85, .2, 1, .1], [.1, .1, .1, 1]])
    kept, dropped = red.greedy_drop(list("abcd"), corr)
    assert dropped == ["a"] and kept == ["b", "c", "d"]


def test_correlation_frame_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    want = np.corrcoef(x.T)
    for r in red.correlation_frame(df, ["a", "b", "c"]).collect():
        assert r.pearson_r == pytest.approx(want["abc".index(r.feature_a), "abc".index(r.feature_b)])
    names, m = red.correlation_matrix(df.withColumn("k", F.lit(1.0)), ["a", "b", "c", "k"])
    assert names == ["a", "b", "c"] and np.allclose(m, want)


def test_two_stage_predicts_zero_below_threshold(spark, tmp_path):
    rows = [(f"2019-{m:02d}", float(x), float(x > 5), float(np.log1p(x)) if x > 5 else 0.0) for m in range(1, 9) for x in range(12)]
    df = spark.createDataFrame(rows, "year_month string, x double, target_is_nonzero double, target_qty_log1p double")
    quick = ml.Settings(n_iter=1, folds=2, space={"maxIter": [3], "maxDepth": [2], "stepSize": [0.3]})
    (clf, _a, _b), (reg, _c, _d) = ml.train_two_stage(df, ["x"], quick)
    out = ml.predict_two_stage(clf, reg, df).select("x", "predicted_qty").distinct().collect()
    assert all((r.predicted_qty == 0.0) == (r.x <= 5) for r in out)
    ml.save_model(reg, str(tmp_path), "reg")
    assert ml.load_model(str(tmp_path), "reg").transform(df).count() == df.count()


class Slow:
    """A stand-in for an estimator: scores are its parameter, and it notes how many fits run at once."""

    running, most, fitted = 0, 0, []

    def __init__(self, x):
        self.x = x

    def fit(self, df):
        Slow.running += 1
        Slow.most = max(Slow.most, Slow.running)
        time.sleep(0.3)
        df.count()
        Slow.fitted.append(self.x)
        Slow.running -= 1
        return self

    def transform(self, df):
        return df.withColumn("p", F.lit(float(self.x)))


@pytest.mark.parametrize("at_once", [1, 4])
def test_search_runs_fits_side_by_side(spark, at_once):
    Slow.running, Slow.most, Slow.fitted = 0, 0, []
    df = spark.createDataFrame([(f"m{i:02d}", 1.0) for i in range(13)], "year_month string, y double")
    settings = ml.Settings(n_iter=4, folds=3, space={"x": [3, 9, 5, 9.0]}, at_once=at_once)
    model, params, score = ml.search(df, lambda p: Slow(p["x"]), lambda scored: scored.agg(F.avg("p")).first()[0], settings)
    assert (params["x"], score, model.x) == (9, 9.0, params["x"])
    assert len(Slow.fitted) == 3 * len(ml.sample_settings(settings.space, 4, settings.seed)) + 1
    assert Slow.most == 1 if at_once == 1 else 1 < Slow.most <= 4


def test_registered_searches_are_whole(monkeypatch):
    """Queries that train models search the operators' own space: every setting, fold and number of trees."""
    import inspect

    from stockloom.plans import q_models
    from stockloom.plans.catalog import QUERIES

    own, seen = ml.Settings(), []

    def noted(*args, **_kw):
        seen.extend(a for a in args if isinstance(a, ml.Settings))
        raise InterruptedError

    monkeypatch.setattr(q_models, "prepared", lambda spark, d: (None, []))
    monkeypatch.setattr(q_models, "matrix", lambda spark, d: type("M", (), {"select": lambda self, *c: self})())
    monkeypatch.setattr(ml, "time_split", lambda *a: (None, None))
    for name in ("train_regressor", "train_classifier", "train_two_stage", "train_cell"):
        monkeypatch.setattr(ml, name, noted)
    names = ["ml3_regressor", "ml4_classifier", "ml5_two_stage", "ml6_random_search", "ml13_grid_routing"]
    for name in names:
        with pytest.raises(InterruptedError):
            QUERIES[name](None, "")
    assert len(seen) == len(names)
    for s in seen:
        assert (s.n_iter, s.folds, s.space) == (own.n_iter, own.folds, ml.SEARCH_SPACE)
    assert "QUICK" not in inspect.getsource(q_models)
