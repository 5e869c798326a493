"""Seasonal-trend decomposition by LOESS (Cleveland and others, 1990) of one short series, with robustness weights."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=256)
def _kernel(n: int, span: int, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """Tricube weights of places 0 .. n - 1 for fits at -ahead .. n - 1 + ahead, and those places."""
    at = np.arange(-ahead, n + ahead, dtype=float)
    if span >= n:
        left, right = np.zeros(len(at)), np.full(len(at), n - 1.0)
    else:
        left = np.clip(np.round(at) - (span + 1) // 2 + 1, 0, n - span)
        right = left + span - 1
    width = np.maximum(at - left, right - at) + (max(span - n, 0) // 2)
    away = np.abs(np.arange(n) - at[:, None])
    weight = np.where(away <= 0.001 * width[:, None], 1.0, (1 - np.minimum(away / np.maximum(width[:, None], 1e-300), 1.0) ** 3) ** 3)
    place = np.arange(n)
    weight[(away > 0.999 * width[:, None]) & (away > 0) | (place < left[:, None]) | (place > right[:, None])] = 0.0
    return weight, at


def loess(y: np.ndarray, span: int, ahead: int = 0, robust: np.ndarray | None = None) -> np.ndarray:
    """Locally linear fits at each place, and ``ahead`` places before and after; where no weight is left, the nearest value."""
    n = len(y)
    base, at = _kernel(n, span, ahead)
    w = base if robust is None else base * robust
    total = w.sum(1)
    ok = total > 0
    w = w / np.where(ok, total, 1.0)[:, None]
    place = np.arange(n)
    mean = w @ place
    spread = (w * (place - mean[:, None]) ** 2).sum(1)
    steep = np.sqrt(spread) > 0.001 * (n - 1)
    slope = np.where(steep, (at - mean) / np.where(steep, spread, 1.0), 0.0)
    w = w * (1 + slope[:, None] * (place - mean[:, None]))
    return np.where(ok, w @ y, y[np.clip(at.astype(int), 0, n - 1)])


def _mean_of(y: np.ndarray, n: int) -> np.ndarray:
    total = np.cumsum(np.append(0.0, y))
    return (total[n:] - total[:-n]) / n


def stl(y: np.ndarray, period: int = 12, seasonal: int = 7, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Trend, seasonal part and residual; None below two periods.

    ``seasonal`` is the span over the years of a calendar month. Trend and low-pass spans follow from
    it and the period. After each outer step, values far from the fit (beyond six median deviations) weigh nothing.
    """
    n = len(y)
    if n < 2 * period:
        return None
    odd = lambda x: int(np.ceil(x)) | 1
    trend_span, low_span = odd(1.5 * period / (1 - 1.5 / seasonal)), odd(period + 1)
    trend, season, robust = np.zeros(n), np.zeros(n), None
    for step in range(outer + 1):
        for _ in range(inner):
            cycle = np.empty(n + 2 * period)
            for phase in range(period):
                part = (y - trend)[phase::period]
                cycle[phase::period] = loess(part, seasonal, 1, None if robust is None else robust[phase::period])
            low = loess(_mean_of(_mean_of(_mean_of(cycle, period), period), 3), low_span)
            season = cycle[period:period + n] - low
            trend = loess(y - season, trend_span, 0, robust)
        if step < outer:
            far = np.abs(y - season - trend)
            edge = 6 * np.median(far)
            if edge <= 1e-9 * np.abs(y).max():  # the fit is exact but for rounding
                robust = np.ones(n)
            else:
                robust = np.where(far <= 0.001 * edge, 1.0, np.where(far <= 0.999 * edge, (1 - np.minimum(far / edge, 1.0) ** 2) ** 2, 0.0))
    return trend, season, y - season - trend
