import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import classify, features as ft, temporal as t


def series(spark, values, start=2018):
    rows = [("o", "i", f"{start + m // 12}-{m % 12 + 1:02d}", v, float(v) * 2, max(v, 0), max(-v, 0)) for m, v in enumerate(values)]
    df = spark.createDataFrame(rows, "outlet_id string, item_code string, year_month string, net_quantity bigint, net_sales double, gross_quantity bigint, return_quantity bigint")
    return df.withColumn("net_sales", F.col("net_sales").cast("decimal(18,4)"))


def test_zero_inflation_runs(spark):
    out = ft.zero_inflation_features(series(spark, [0, 0, 5, 0, 0, 3, -2, 0])).orderBy("year_month").collect()
    assert [r.months_since_last_purchase for r in out] == [None, None, 0, 1, 2, 0, 1, 2]
    assert [r.consecutive_zeros for r in out] == [0, 1, 0, 1, 2, 0, 0, 2]
    assert out[5].demand_event_rate_6m == pytest.approx(2 / 6)
    shifted = ft.zero_inflation_features(series(spark, [0, 0, 5, 0, 0, 3, -2, 0]), exclude_current=True).orderBy("year_month").collect()
    assert shifted[0].demand_event_rate_6m is None and shifted[3].demand_event_rate_6m == pytest.approx(1 / 3)


def test_lags_rolling_and_targets(spark):
    v = [3, 0, 7, 2, 0, 0, 9, 4, 1, 0, 6, 5, 8, 2]
    df = series(spark, v)
    out = ft.lag_rolling_features(df).orderBy("year_month").collect()
    assert [r.lag_qty_12m is not None for r in out].count(True) == 2
    assert out[13].lag_qty_12m == pytest.approx(math.log1p(0))
    for at in range(len(v)):
        for n in (3, 6, 12):
            part = v[max(0, at - n + 1):at + 1]
            assert out[at][f"roll_mean_qty_{n}m"] == pytest.approx(np.mean(part))
            assert out[at][f"roll_mean_sales_{n}m"] == pytest.approx(np.mean(part) * 2)
            assert out[at][f"roll_nonzero_count_{n}m"] == sum(x > 0 for x in part)
            std = out[at][f"roll_std_qty_{n}m"]
            assert std is None if at == 0 else std == pytest.approx(np.std(part, ddof=1))
    assert out[12].yoy_growth == pytest.approx((8 - 3) / (3 + 1e-8))
    assert out[6].trend_slope_approx == pytest.approx((v[5] - v[0]) / 5)
    assert not [c for c in out[0].asDict() if c.startswith("_")]
    targets = ft.targets(df).orderBy("year_month").collect()
    assert [r.target_qty_raw for r in targets] == [*v[2:], None, None]


def test_log_of_negative_quantity_is_null(spark):
    out = ft.targets(series(spark, [1, 1, -2, -1, 0])).orderBy("year_month").collect()
    assert [r.target_qty_log1p for r in out] == [None, None, 0.0, None, None]


def test_class_boundaries(spark):
    df = spark.createDataFrame([(0.80, 0.49), (0.80, 0.50), (0.20, 1.00), (0.19, 0.1), (0.5, 1.01)], "a double, c double")
    got = [r[0] for r in df.select(classify.demand_class(F.col("a"), F.col("c"))).collect()]
    assert got == ["Continuous", "Intermittent", "Intermittent", "Lumpy", "Lumpy"]


def test_decomposition_recovers_season(spark):
    season = [math.sin(2 * math.pi * m / 12) * 10 for m in range(12)]
    rows = [("s", f"{2015 + m // 12}-{m % 12 + 1:02d}", 100.0 + 2 * m + season[m % 12]) for m in range(60)]
    df = spark.createDataFrame(rows, "k string, year_month string, value double")
    parts = t.decompose(df, ["k"])
    got = [r.seasonal for r in parts.orderBy("year_month").limit(12).collect()]
    assert got == pytest.approx(season, abs=1e-6)
    assert t.seasonal_strength(parts, ["k"]).first().seasonal_strength == pytest.approx(1.0)


def test_autocorrelation_and_ljung_box(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=50), 3)
    rows = [("s", f"{2015 + m // 12}-{m % 12 + 1:02d}", float(v)) for m, v in enumerate(x)]
    acf = t.autocorrelation(spark.createDataFrame(rows, "k string, year_month string, value double"), ["k"], 12)
    e = x - x.mean()
    want = [float((e[k:] * e[:-k]).sum() / (e * e).sum()) for k in range(1, 13)]
    assert [r.acf for r in acf.orderBy("lag").collect()] == pytest.approx(want)
    assert t.ljung_box(acf, ["k"]).first().q_6 == pytest.approx(50 * 52 * sum(w * w / (50 - k) for k, w in enumerate(want[:6], 1)))
    pacf = [r.pacf for r in t.partial_autocorrelation(acf, ["k"]).orderBy("lag").collect()]
    for k in (1, 2, 5):  # last coefficient of the Yule-Walker equations
        m = np.array([[1.0 if i == j else want[abs(i - j) - 1] for j in range(k)] for i in range(k)])
        assert pacf[k - 1] == pytest.approx(np.linalg.solve(m, want[:k])[-1])
