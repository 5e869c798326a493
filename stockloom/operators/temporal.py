"""Trend, seasonality, stationarity and autocorrelation of many monthly series at once.

Every operator takes a long frame (keys…, year_month, value) of zero-filled
series. A series is as long as the window has months, so one series per window
group is small; the number of series may be any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.functions.clean import month_of, ratio, year_of
from stockloom.functions.loess import stl
from stockloom.functions.stats import chi2_tail_even, pacf_of
from stockloom.operators.classify import demand_class
from stockloom.operators.ordering import quantiles
from stockloom.operators.relational import centred_mean, percent_change

UNIT_ROOT_5PCT = -2.86
KPSS_5PCT = 0.463
# Response surface of the 5 % critical value with a constant (MacKinnon 2010), by powers of 1 / rows.
ADF_5PCT = [-2.86154, -2.8903, -4.234, -40.040]
STRONG_SEASON = 0.6


def _order(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("year_month")


def trend_and_growth(series: DataFrame, keys: list[str]) -> DataFrame:
    """Centred moving averages (3, 12) and change over 1 and 12 months in percent."""
    v = F.col("value")
    return series.withColumns({
        "ma3": centred_mean(v, keys, 3), "ma12": centred_mean(v, keys, 12),
        "mom_growth": percent_change(v, keys, 1), "yoy_growth": percent_change(v, keys, 12),
    })


def growth_summary(series: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, median, smallest and largest year-on-year change per series."""
    yoy = trend_and_growth(series, keys).where("yoy_growth is not null")
    spread = yoy.groupBy(*keys).agg(
        F.avg("yoy_growth").alias("mean_yoy"), F.min("yoy_growth").alias("min_yoy"), F.max("yoy_growth").alias("max_yoy"),
        # at most one value per month: the exact percentile holds one short series
        F.percentile("yoy_growth", 0.5).alias("median_yoy"),
    )
    return spread


def decompose(series: DataFrame, keys: list[str]) -> DataFrame:
    """Additive decomposition, period 12: trend, seasonal and residual part.

    Trend is the centred 2x12 moving average; the seasonal part is the mean of
    the detrended values per calendar month, shifted to average zero.
    """
    w = _order(keys)
    v = F.col("value").cast("double")
    wide, narrow = w.rowsBetween(-6, 6), w.rowsBetween(-5, 5)
    ends = F.lag(v, 6).over(w) + F.lead(v, 6).over(w)
    full = F.count(v).over(wide) == 13
    trend = F.when(full, (F.sum(v).over(narrow) + ends / 2) / 12)
    parts = series.withColumn("trend", trend).withColumn("month_int", month_of(F.col("year_month")))
    monthly = Window.partitionBy(*keys, "month_int")
    parts = parts.withColumn("_season", F.avg(v - F.col("trend")).over(monthly))
    # mean over the twelve calendar months, each counted once
    per_month = F.col("_season") / F.count("*").over(monthly)
    level = Window.partitionBy(*keys)
    parts = parts.withColumn("_part", per_month).withColumn(
        "_months", F.size(F.collect_set("month_int").over(level)))
    parts = parts.withColumn("seasonal", F.col("_season") - F.sum("_part").over(level) / F.col("_months"))
    return parts.withColumn("resid", v - F.col("trend") - F.col("seasonal")).drop("_season", "_part", "_months")


def decompose_robust(series: DataFrame, keys: list[str], period: int = 12) -> DataFrame:
    """Trend, seasonal and residual part by LOESS with robustness weights, for every month of every series.

    A series is one array; tasks decompose the series of their batches. Series of less than two
    periods have NULL parts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for v in b.column("_v"):
                y = np.array(v.as_py(), float)
                found = stl(y, period)
                parts.append([None] * 3 if found is None else [x.tolist() for x in found])
            columns = [*(b.column(c) for c in [*keys, "_m", "_v"]), *(pa.array([p[k] for p in parts], pa.list_(pa.float64())) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "_m", "_v", "_t", "_s", "_r"])

    pairs = F.array_sort(F.collect_list(F.struct("year_month", F.col("value").cast("double").alias("value"))))
    rows = series.where("value is not null").groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.col("_p.year_month").alias("_m"), F.col("_p.value").alias("_v"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    done = rows.mapInArrow(run, f"{head}, _m array<string>, _v array<double>, _t array<double>, _s array<double>, _r array<double>")
    cells = F.transform("_m", lambda m, i: F.struct(m.alias("year_month"), F.col("_v")[i].alias("value"), F.col("_t")[i].alias("trend"), F.col("_s")[i].alias("seasonal"), F.col("_r")[i].alias("resid")))
    return done.select(*keys, F.explode(cells).alias("_x")).select(*keys, "_x.*")


def seasonal_strength(parts: DataFrame, keys: list[str]) -> DataFrame:
    """var(seasonal) / (var(seasonal) + var(residual)) over months that have a residual."""
    has = F.col("resid").isNotNull()
    out = parts.groupBy(*keys).agg(
        F.var_pop(F.when(has, F.col("seasonal"))).alias("_s"), F.var_pop("resid").alias("_r"))
    strength = ratio(F.col("_s"), F.col("_s") + F.col("_r"))
    return out.select(*keys, strength.alias("seasonal_strength"), (strength > STRONG_SEASON).alias("is_strong"))


def seasonal_index(series: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of each calendar month over the mean of the series, with peak and trough flags."""
    month = month_of(F.col("year_month")).alias("month_int")
    per_month = series.groupBy(*keys, month).agg(
        F.avg("value").alias("_mean"), F.sum("value").alias("_sum"), F.count("value").alias("_n"))
    w = Window.partitionBy(*keys)  # twelve rows
    overall = ratio(F.sum("_sum").over(w), F.sum("_n").over(w))
    out = per_month.withColumn("seasonal_index", ratio(F.col("_mean"), overall))
    high = F.row_number().over(w.orderBy(F.desc("seasonal_index"), "month_int"))
    low = F.row_number().over(w.orderBy("seasonal_index", "month_int"))
    return out.withColumns({"is_peak": high == 1, "is_trough": low == 1}).select(
        *keys, "month_int", "seasonal_index", "is_peak", "is_trough")


def year_month_pivot(series: DataFrame, keys: list[str]) -> DataFrame:
    """Years down, calendar months across."""
    ym = F.col("year_month")
    flat = series.select(*keys, year_of(ym).alias("year"), F.concat(F.lit("m"), F.substring(ym, 6, 2)).alias("_m"), "value")
    return flat.groupBy(*keys, "year").pivot("_m", [f"m{m:02d}" for m in range(1, 13)]).agg(F.sum("value"))


def differenced(series: DataFrame, keys: list[str]) -> DataFrame:
    """First differences; the first month is dropped."""
    d = F.col("value") - F.lag("value").over(_order(keys))
    return series.withColumn("value", d).where("value is not null")


def unit_root(series: DataFrame, keys: list[str]) -> DataFrame:
    """Dickey-Fuller t statistic with a constant and no lagged differences."""
    before = F.lag("value").over(_order(keys)).cast("double")
    steps = series.select(*keys, (F.col("value") - before).alias("dy"), before.alias("y1")).where("y1 is not null")
    sums = steps.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_sxx("dy", "y1").alias("sxx"), F.regr_syy("dy", "y1").alias("syy"), F.regr_sxy("dy", "y1").alias("sxy"))
    slope = ratio(F.col("sxy"), F.col("sxx"))
    error = F.col("syy") - slope * F.col("sxy")
    t = ratio(slope, F.sqrt(F.try_divide(F.try_divide(error, F.col("n") - 2), F.col("sxx"))))
    return sums.select(*keys, t.alias("df_t"), (t < UNIT_ROOT_5PCT).alias("df_stationary"))


def level_stationarity(series: DataFrame, keys: list[str], lags: int = 12) -> DataFrame:
    """KPSS statistic around a constant with a fixed Bartlett window."""
    whole, w = Window.partitionBy(*keys), _order(keys)
    v = F.col("value").cast("double")
    centred = series.withColumn("_e", v - F.avg(v).over(whole))
    products = centred.select(
        *keys, (F.col("_e") * F.col("_e")).alias("_p0"),
        *[(F.col("_e") * F.lag("_e", k).over(w)).alias(f"_p{k}") for k in range(1, lags + 1)],
        F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_s"))
    sums = products.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("_s") * F.col("_s")).alias("_ss"),
        *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_p{k}") for k in range(lags + 1)])
    long_run = F.col("_p0")
    for k in range(1, lags + 1):
        long_run = long_run + 2 * (1 - k / (lags + 1)) * F.col(f"_p{k}")
    stat = ratio(F.col("_ss"), F.col("n") * F.col("n") * (long_run / F.col("n")))
    return sums.select(*keys, stat.alias("kpss"), (stat < KPSS_5PCT).alias("kpss_stationary"))


def _arrays(series: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series: its values in order of the months, without NULLs."""
    pairs = F.array_sort(F.collect_list(F.struct("year_month", F.col("value").cast("double").alias("value"))))
    return series.where("value is not null").groupBy(*keys).agg(pairs.alias("_s")).select(*keys, F.col("_s.value").alias("_v"))


def level_stationarity_auto(series: DataFrame, keys: list[str]) -> DataFrame:
    """KPSS statistic around a constant whose Bartlett window follows from the data (Hobijn, Franses and Ooms).

    The window grows with the ratio of the first autocovariances' weighted sum to their sum, found by folds over each
    series' array. A constant series has no statistic.
    """
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    rows = _arrays(series, keys).withColumn("n", F.size("_v")).withColumn("_m", total(F.col("_v")) / F.col("n"))
    rows = rows.withColumn("_e", F.transform("_v", lambda x: x - F.col("_m")))
    n, e = F.col("n").cast("double"), F.col("_e")

    def product(k: Column) -> Column:
        return total(F.zip_with(F.slice(e, F.lit(1), F.col("n") - k), F.slice(e, k + 1, F.col("n") - k), lambda x, y: x * y))

    def upto(k: Column) -> Column:
        return F.when(k > 0, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    first = upto(F.floor(F.pow(n, F.lit(2 / 9))).cast("int"))
    rows = rows.withColumns({"_p0": product(F.lit(0)), "_c": F.transform(first, lambda k: product(k) / (n / 2))})
    s0 = F.col("_p0") / n + total(F.col("_c"))
    s1 = total(F.transform("_c", lambda c, k: c * (k + 1)))
    ratio_ = F.try_divide(s1, s0)
    wide = F.floor(1.1447 * F.pow(ratio_ * ratio_, F.lit(1 / 3)) * F.pow(n, F.lit(1 / 3))).cast("int")
    rows = rows.withColumn("lags", F.least(F.coalesce(wide, F.lit(0)), F.col("n") - 1))
    weighted = total(F.transform(upto(F.col("lags")), lambda k: 2 * (1 - k / (F.col("lags") + 1.0)) * product(k)))
    sums = F.aggregate(e, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
                       lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + (a["s"] + x) * (a["s"] + x)).alias("q")), lambda a: a["q"])
    stat = ratio(sums, n * (F.col("_p0") + weighted))
    return rows.select(*keys, F.col("n").cast("long").alias("n"), F.col("lags").cast("long").alias("lags"), stat.alias("kpss"), (stat < KPSS_5PCT).alias("kpss_stationary"))


def adf(values: np.ndarray) -> tuple[float, int, int] | None:
    """Augmented Dickey-Fuller t statistic with a constant, the number of lagged differences and of rows.

    Up to 12 (n / 100)^(1/4) lags compete on the same rows by AIC; the best is fitted again on all rows it
    can use. None for series that are too short or constant.
    """
    n = len(values)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    if most < 0 or np.ptp(values) == 0:
        return None
    change = np.diff(values)

    def fitted(lags: int, drop: int) -> tuple[float, float, int]:
        """(t of the level, AIC, rows) with the first ``drop`` differences left out."""
        y = change[drop:]
        x = np.column_stack([values[drop:-1], np.ones(len(y)), *(change[drop - k:len(change) - k] for k in range(1, lags + 1))])
        q, r = np.linalg.qr(x)
        if np.abs(np.diag(r)).min() <= 1e-10 * np.abs(np.diag(r)).max() or len(y) <= x.shape[1]:
            return math.nan, math.inf, len(y)
        inverse = np.linalg.inv(r)
        beta = inverse @ (q.T @ y)
        rest = float(((y - x @ beta) ** 2).sum())
        error = math.sqrt(rest / (len(y) - x.shape[1])) * math.sqrt(float((inverse[0] ** 2).sum()))
        return beta[0] / error if error > 0 else math.nan, len(y) * math.log(max(rest, 1e-300) / len(y)) + 2 * x.shape[1], len(y)

    best = min(range(most + 1), key=lambda k: fitted(k, most)[1])
    t, aic, rows = fitted(best, best)
    return None if math.isnan(t) or math.isinf(aic) else (t, best, rows)


def unit_root_auto(series: DataFrame, keys: list[str]) -> DataFrame:
    """Augmented Dickey-Fuller test of every series: adf_t, lags chosen by AIC, 5 % critical value for its length, verdict.

    Each series is one array, so tasks fit the series of their batches; a series that is too short or constant
    has NULLs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [adf(np.array(v.as_py(), float)) for v in b.column("_v")]
            critical = [None if f is None else sum(c / f[2] ** k for k, c in enumerate(ADF_5PCT)) for f in found]
            columns = [*(b.column(k) for k in keys), pa.array([f and f[0] for f in found], pa.float64()), pa.array([f and f[1] for f in found], pa.int64()), pa.array(critical, pa.float64()),
                       pa.array([None if f is None else f[0] < c for f, c in zip(found, critical)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "adf_t", "lags", "critical_5pct", "adf_stationary"])

    rows = _arrays(series, keys)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return rows.select(*keys, "_v").mapInArrow(run, f"{head}, adf_t double, lags long, critical_5pct double, adf_stationary boolean")


def integration_order(series: DataFrame, keys: list[str]) -> DataFrame:
    """I(1), I(0) or conflict from both screens at level and first difference."""
    diff = differenced(series, keys)
    level = unit_root(series, keys).join(level_stationarity(series, keys), keys)
    step = unit_root(diff, keys).join(level_stationarity(diff, keys), keys).withColumnsRenamed(
        {c: f"d1_{c}" for c in ("df_t", "df_stationary", "kpss", "kpss_stationary")})
    verdict = (
        F.when(F.col("d1_df_stationary") & F.col("d1_kpss_stationary"), "I(1)")
        .when(F.col("df_stationary") & F.col("kpss_stationary"), "I(0)").otherwise("conflict"))
    return level.join(step, keys).withColumn("verdict", verdict)


def autocorrelation(series: DataFrame, keys: list[str], lags: int = 36) -> DataFrame:
    """Autocorrelation per lag, long form (keys…, lag, n, acf)."""
    w = _order(keys)
    v = F.col("value").cast("double")
    centred = series.withColumn("_e", v - F.avg(v).over(Window.partitionBy(*keys)))
    shifted = centred.select(*keys, "_e", *[F.lag("_e", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    sums = shifted.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("_e") * F.col("_e")).alias("_v"),
        *[F.sum(F.col("_e") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)])
    cells = ", ".join(f"{k}, _c{k}" for k in range(1, lags + 1))
    long = sums.select(*keys, "n", "_v", F.expr(f"stack({lags}, {cells}) as (lag, _c)"))
    return long.where("_c is not null").select(*keys, "lag", "n", ratio(F.col("_c"), F.col("_v")).alias("acf"))


def partial_autocorrelation(acf: DataFrame, keys: list[str]) -> DataFrame:
    """Partial autocorrelation per lag from the short ACF array of each series; a constant series has none."""
    arrays = acf.where("acf is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("_a"))
    out = arrays.select(*keys, pacf_of(F.col("_a.acf")).alias("_p"))
    return out.select(*keys, F.posexplode("_p").alias("_i", "pacf")).select(*keys, (F.col("_i") + 1).alias("lag"), "pacf")


def ljung_box(acf: DataFrame, keys: list[str], horizons: tuple[int, ...] = (6, 12)) -> DataFrame:
    """Q statistic and tail probability at each horizon."""
    part = F.try_divide(F.col("acf") * F.col("acf"), F.col("n") - F.col("lag"))
    scale = F.max("n") * (F.max("n") + 2)
    sums = acf.groupBy(*keys).agg(*[(scale * F.sum(F.when(F.col("lag") <= h, part))).alias(f"q_{h}") for h in horizons])
    return sums.withColumns({f"p_{h}": chi2_tail_even(F.col(f"q_{h}"), h) for h in horizons})


def monthly_return_rate(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Returned over invoiced quantity per month with invoices."""
    by = list(by or [])
    kind, q = F.col("document_type"), F.col("quantity")
    sums = lines.groupBy(*by, "year_month").agg(
        F.sum(F.when(kind == "invoice", q)).alias("invoice_qty"),
        F.coalesce(F.sum(F.when(kind == "return", F.abs(q))), F.lit(0)).alias("return_qty"))
    return sums.where("invoice_qty is not null").withColumn("return_rate", ratio(F.col("return_qty"), F.col("invoice_qty")))


def return_anomalies(rates: DataFrame, prob: float = 0.95) -> DataFrame:
    """Months whose return rate lies above the given quantile."""
    edge = quantiles(rates, ["return_rate"], [prob]).toDF("p95")
    return rates.crossJoin(F.broadcast(edge)).where(F.col("return_rate") > F.col("p95"))


def series_pattern(demand: DataFrame, keys: list[str], months: DataFrame) -> DataFrame:
    """Active share, CV and demand interval per series, all months in the deviation.

    ``demand`` may leave empty months out: the moments are completed with zeros
    from the month count (one-row frame ``total_months``).
    """
    q = F.col("net_quantity")
    sold = F.when(q > 0, q)
    summed = demand.groupBy(*keys, "year_month").agg(F.sum("net_quantity").alias("net_quantity"))
    stats = summed.groupBy(*keys).agg(
        F.count(sold).alias("active_months"), F.sum(q).alias("total_net_quantity"),
        F.sum(q.cast("double") * q).alias("_sq"), F.avg(sold).alias("mean_active_qty"))
    n, s = F.col("total_months"), F.col("total_net_quantity")
    # n·Σx² − (Σx)² is a whole number for whole quantities
    variance = F.try_divide(n * F.col("_sq") - s.cast("double") * s, n * (n - 1))
    cv = F.try_divide(F.sqrt(F.greatest(variance, F.lit(0.0))), F.col("mean_active_qty"))
    return stats.crossJoin(F.broadcast(months)).withColumns({
        "active_frac": ratio(F.col("active_months"), n), "cv": cv,
        "demand_interval": ratio(n, F.greatest(F.col("active_months"), F.lit(1))),
    }).withColumn("demand_class", demand_class(F.col("active_frac"), F.col("cv"))).drop("_sq", "total_months")


def class_shares(patterns: DataFrame) -> DataFrame:
    """Series per demand class with percent (one decimal)."""
    from stockloom.operators.relational import share_of_total

    counted = patterns.groupBy("demand_class").agg(F.count("*").alias("n"))
    return share_of_total(counted, "n", "_s").withColumn("pct", F.round(F.col("_s") * 100, 1)).drop("_s")


def cv_tier(cv: Column) -> Column:
    return (
        F.when(cv.isNull(), "N/A").when(cv < 0.3, "Low (<0.3)").when(cv < 0.6, "Medium (0.3–0.6)").otherwise("High (>0.6)"))


def cv_summary(patterns: DataFrame) -> DataFrame:
    """Median, 90th percentile and mean CV, and the stock multiple against a CV of 0.3."""
    q = quantiles(patterns, ["cv"], [0.5, 0.9])
    mean = patterns.agg(F.avg("cv").alias("mean_cv"))
    return q.crossJoin(mean).withColumn("stock_multiple", F.col("cv_p90") / 0.3)
