"""Unit-root and level-stationarity tests of many series against plain versions."""

import math

import numpy as np
import pytest

from stockloom.operators import temporal as t


def plain_adf(v):
    """Normal equations and residuals, one lag after the other."""
    n, dv = len(v), np.diff(v)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def ols(lags, first):
        y = np.array([dv[i] for i in range(first, len(dv))])
        x = np.array([[1.0, v[i], *(dv[i - k] for k in range(1, lags + 1))] for i in range(first, len(dv))])
        beta = np.linalg.solve(x.T @ x, x.T @ y)
        rest = ((y - x @ beta) ** 2).sum()
        llf = -len(y) / 2 * (math.log(2 * math.pi) + math.log(rest / len(y)) + 1)
        cov = np.linalg.inv(x.T @ x) * rest / (len(y) - x.shape[1])
        return beta[1] / math.sqrt(cov[1, 1]), -2 * llf + 2 * x.shape[1]

    best = min(range(most + 1), key=lambda k: ols(k, most)[1])
    return ols(best, best)[0], best


def plain_kpss(v):
    n, e = len(v), v - v.mean()
    s0, s1 = (e @ e) / n, 0.0
    for k in range(1, int(n ** (2 / 9)) + 1):
        c = e[k:] @ e[:n - k] / (n / 2)
        s0, s1 = s0 + c, s1 + k * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    spread = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:n - k]) for k in range(1, lags + 1))) / n
    return (e.cumsum() ** 2).sum() / n ** 2 / spread, lags


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(5)
    values = {}
    for i in range(30):
        n = int(rng.integers(24, 140))
        noise = rng.normal(size=n) * 10
        values[f"walk{i}"], values[f"noise{i}"] = noise.cumsum(), noise
        ar = np.zeros(n)
        for k in range(2, n):
            ar[k] = 0.6 * ar[k - 1] - 0.3 * ar[k - 2] + noise[k]
        values[f"ar{i}"] = ar
    month = lambda m: f"{2000 + m // 12}-{m % 12 + 1:02d}"
    rows = [(k, month(m), float(x)) for k, v in values.items() for m, x in enumerate(v)]
    rows += [("flat", month(m), 3.0) for m in range(30)] + [("short", month(m), float(m % 2)) for m in range(3)] + [("gap", month(0), None)]
    return values, spark.createDataFrame(rows, "k string, year_month string, value double").repartition(4)


def test_augmented_dickey_fuller(many):
    values, df = many
    got = {r.k: r for r in t.unit_root_auto(df, ["k"]).collect()}
    assert set(got) == {*values, "flat", "short"} and got["flat"].adf_t is None and got["short"].adf_t is None
    for k, v in values.items():
        stat, lags = plain_adf(v)
        assert got[k].lags == lags and got[k].adf_t == pytest.approx(stat, rel=1e-6) and got[k].adf_stationary == (got[k].adf_t < got[k].critical_5pct)
    assert len({r.lags for r in got.values()}) > 3
    assert sum(got[f"noise{i}"].adf_stationary for i in range(30)) > sum(got[f"walk{i}"].adf_stationary for i in range(30)) + 10
    assert got["noise0"].critical_5pct == pytest.approx(-2.86, abs=0.2)


def test_kpss_with_window_from_the_data(many):
    values, df = many
    got = {r.k: r for r in t.level_stationarity_auto(df, ["k"]).collect()}
    assert got["flat"].kpss is None
    for k, v in values.items():
        stat, lags = plain_kpss(v)
        assert got[k].lags == lags and got[k].kpss == pytest.approx(stat, rel=1e-9) and got[k].n == len(v)
