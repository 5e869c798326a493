"""Tail probabilities and partial autocorrelation as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

# Coefficients of the logarithm of the gamma function (Lanczos, g = 7).
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
TINY = 1e-300


def chi2_tail_even(stat: Column, dof: int) -> Column:
    """P(X > stat) of a chi-square with an even number of degrees of freedom, as a plain expression."""
    if dof % 2:
        raise ValueError("dof must be even")
    half = stat / 2
    term, total = F.lit(1.0), F.lit(1.0)
    for k in range(1, dof // 2):
        term = term * half / F.lit(float(k))
        total = total + term
    return F.exp(-half) * total


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 0.5."""
    t = x + 6.5
    series = reduce(lambda a, b: a + b, [F.lit(LANCZOS[0]), *[F.lit(c) / (x + (i - 1)) for i, c in enumerate(LANCZOS[1:], 1)]])
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.log(t) - t + F.log(series)


def _steps(size: Column) -> Column:
    """1, 2, … for as many terms as sums and fractions of that size may need."""
    return F.sequence(F.lit(1), (F.lit(80) + 10 * F.sqrt(size)).cast("int"))


def _away(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, TINY).otherwise(x)


def gamma_tail(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma: a power series below a + 1, a continued fraction above it."""
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    series = F.aggregate(
        _steps(a), F.struct((1.0 / a).alias("term"), (1.0 / a).alias("total")),
        lambda s, k: F.struct((s["term"] * x / (a + k)).alias("term"), (s["total"] + s["term"] * x / (a + k)).alias("total")),
        lambda s: s["total"])

    def step(s: Column, k: Column) -> Column:
        part = k * (a - k)
        b = x + 1 - a + 2 * k
        d = 1.0 / _away(part * s["d"] + b)
        c = _away(b + part / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    first = 1.0 / _away(x + 1 - a)
    fraction = F.aggregate(_steps(a), F.struct(F.lit(1.0 / TINY).alias("c"), first.alias("d"), first.alias("h")), step, lambda s: s["h"])
    return F.when(x <= 0, 1.0).when(x < a + 1, 1.0 - front * series).otherwise(front * fraction)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    def half(c: Column, d: Column, h: Column, part: Column) -> tuple[Column, Column, Column]:
        d = 1.0 / _away(1.0 + part * d)
        c = _away(1.0 + part / c)
        return c, d, h * c * d

    def even(s: Column, m: Column) -> Column:
        c, d, h = half(s["c"], s["d"], s["h"], m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def odd(s: Column, m: Column) -> Column:
        c, d, h = half(s["c"], s["d"], s["h"], -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    start = 1.0 / _away(1.0 - (a + b) * x / (a + 1.0))
    # the two parts of a step alternate: 2, 3, 4, 5 … stand for (1, even), (1, odd), (2, even), (2, odd) …
    parts = F.sequence(F.lit(2), 2 * (F.lit(80) + 10 * F.sqrt(F.greatest(a, b))).cast("int") + 1)
    return F.aggregate(
        parts, F.struct(F.lit(1.0).alias("c"), start.alias("d"), start.alias("h")),
        lambda s, k: F.when(k % 2 == 0, even(s, F.floor(k / 2).cast("double"))).otherwise(odd(s, F.floor(k / 2).cast("double"))), lambda s: s["h"])


def beta_ratio(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta by its continued fraction, on the side where it converges fast."""
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x <= (a + 1) / (a + b + 2), front / a * _beta_fraction(a, b, x)).otherwise(
        1.0 - front / b * _beta_fraction(b, a, 1.0 - x))


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chi2_p(stat: Column | str, dof: Column | str) -> Column:
    """P(X > stat) of a chi-square; NULL for NULL, NaN or less than one degree of freedom."""
    stat, dof = _column(stat).cast("double"), _column(dof).cast("double")
    return F.when((dof >= 1) & ~F.isnan(stat), gamma_tail(dof / 2, stat / 2))


def f_p(stat: Column | str, d1: Column | str, d2: Column | str) -> Column:
    """P(F > stat); NULL for NULL, NaN or degrees of freedom that are not positive."""
    stat, d1, d2 = (_column(c).cast("double") for c in (stat, d1, d2))
    return F.when((d1 >= 1) & (d2 >= 1) & stat.isNotNull() & ~F.isnan(stat), beta_ratio(d2 / 2, d1 / 2, d2 / (d2 + d1 * F.greatest(stat, F.lit(0.0)))))


def pacf_of(acf: Column) -> Column:
    """Partial autocorrelations of lags 1..k from the array of autocorrelations of lags 1..k (Durbin–Levinson).

    NULL from the first lag whose variance left is not positive.
    """
    empty = F.array().cast("array<double>")

    def times(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(s: Column, k: Column) -> Column:
        before = F.slice(acf, F.lit(1), k)
        rest = 1.0 - times(s["phi"], before)
        new = F.when(rest > 0, (F.element_at(acf, k + 1) - times(s["phi"], F.reverse(before))) / rest)
        phi = F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda x, y: x - new * y), F.array(new))
        return F.struct(phi.alias("phi"), F.concat(s["out"], F.array(new)).alias("out"))

    return F.when(F.size(acf) > 0, F.aggregate(
        F.sequence(F.lit(0), F.size(acf) - 1), F.struct(empty.alias("phi"), empty.alias("out")), step, lambda s: s["out"]))
