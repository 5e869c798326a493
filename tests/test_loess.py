"""Robust seasonal-trend decomposition against a plain version, point by point."""

import numpy as np
import pytest

from stockloom.functions import loess as lo
from stockloom.operators import temporal as t


def plain_fit(y, span, x, robust=None):
    """One locally linear fit by weighted least squares; x counts from 0."""
    n = len(y)
    if span >= n:
        left, right = 0, n - 1
    else:
        left = min(max(x - (span - 1) // 2, 0), n - span)
        right = left + span - 1
    h = max(x - left, right - x) + (max(span - n, 0) // 2)
    places = [j for j in range(left, right + 1) if abs(j - x) <= 0.999 * h or j == x]
    w = np.array([1.0 if abs(j - x) <= 0.001 * h else (1 - (abs(j - x) / h) ** 3) ** 3 for j in places])
    if robust is not None:
        w = w * np.array([robust[j] for j in places])
    if w.sum() <= 0:
        return y[min(max(x, 0), n - 1)]
    j, v = np.array(places, float), np.array([y[k] for k in places])
    mean, level = (w @ j) / w.sum(), (w @ v) / w.sum()
    spread = w @ (j - mean) ** 2 / w.sum()
    return level + ((x - mean) * (w @ ((j - mean) * v)) / w.sum() / spread if np.sqrt(spread) > 0.001 * (n - 1) else 0.0)


def plain_stl(y, period=12, seasonal=7, inner=2, outer=15):
    n = len(y)
    trend, robust = np.zeros(n), None
    for step in range(outer + 1):
        for _ in range(inner):
            cycle = np.zeros(n + 2 * period)
            for p in range(period):
                part = [y[i] - trend[i] for i in range(p, n, period)]
                rw = None if robust is None else [robust[i] for i in range(p, n, period)]
                for k in range(-1, len(part) + 1):
                    cycle[p + (k + 1) * period] = plain_fit(part, seasonal, k, rw)
            a = np.array([cycle[i:i + period].mean() for i in range(len(cycle) - period + 1)])
            a = np.array([a[i:i + period].mean() for i in range(len(a) - period + 1)])
            a = np.array([a[i:i + 3].mean() for i in range(len(a) - 2)])
            low = [plain_fit(a, 13, i) for i in range(n)]
            season = cycle[period:period + n] - low
            rest = y - season
            trend = np.array([plain_fit(rest, 23, i, robust) for i in range(n)])
        if step < outer:
            r = np.abs(y - season - trend)
            h = 6 * np.median(r)
            robust = np.ones(n) if h <= 1e-9 * np.abs(y).max() else np.array([1.0 if x <= 0.001 * h else (1 - (x / h) ** 2) ** 2 if x <= 0.999 * h else 0.0 for x in r])
    return trend, season, y - season - trend


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    wave = 40 * np.sin(np.arange(200) * np.pi / 6)
    return {f"s{n}": wave[:n] + 0.5 * np.arange(n) + rng.normal(size=n) * 3 + (rng.random(n) < 0.04) * 300 for n in (24, 25, 37, 63, 84, 130)}


def test_equals_plain_version(values):
    for y in values.values():
        for got, want in zip(lo.stl(y), plain_stl(y)):
            assert np.allclose(got, want, atol=1e-7)


def test_outliers_stay_out_of_the_parts():
    clean = 40 * np.sin(np.arange(84) * np.pi / 6) + 0.5 * np.arange(84)
    dirty = clean.copy()
    dirty[[20, 50]] += 500
    trend, season, rest = lo.stl(dirty)
    assert abs(rest[20] - 500) < 10 and abs(rest[50] - 500) < 10
    assert np.abs(trend - 0.5 * np.arange(84)).max() < 5 and np.abs(season - 40 * np.sin(np.arange(84) * np.pi / 6)).max() < 5
    assert lo.stl(np.zeros(23)) is None and all(np.allclose(x, 0) for x in lo.stl(np.zeros(30)))


def test_all_series_of_a_table(spark, values):
    month = lambda m: f"{2000 + m // 12}-{m % 12 + 1:02d}"
    rows = [(k, month(m), float(x)) for k, y in values.items() for m, x in enumerate(y)] + [("short", month(m), 1.0) for m in range(5)] + [("short", month(5), None)]
    got = t.decompose_robust(spark.createDataFrame(rows, "k string, year_month string, value double").repartition(4), ["k"]).collect()
    assert len(got) == len(rows) - 1 and all(r.trend is None and r.resid is None for r in got if r.k == "short")
    for k, y in values.items():
        mine = sorted((r.year_month, r.value, r.trend, r.seasonal, r.resid) for r in got if r.k == k)
        want = lo.stl(y)
        assert np.allclose([r[1:] for r in mine], np.column_stack([y, *want]))
