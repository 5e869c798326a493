"""Feature matrix on the outlet x SKU x month grid.

All window features of a series share one partitioning and one order, so lags,
leads and rolling frames are planned as one exchange and one sort; the grid
already arrives partitioned by (outlet, SKU) from its builder.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.functions.clean import log1p_or_null, month_of, remap, year_of
from stockloom.operators import series

PAIR = ["outlet_id", "item_code"]
EPS = 1e-8
# Codes of segments and demand classes.
CLUSTER_CODES = {"Power": 0, "High-Value Active": 1, "Low-Value Sporadic": 2}
CLASS_CODES = {"Continuous": 0, "Intermittent": 1, "Lumpy": 2}
# Historical return rate of each product category.
CATEGORY_RETURN_RATES = {
    "cat_2": 0.1180, "cat_3": 0.0916, "cat_4": 0.0832, "cat_5": 0.0664, "cat_6": 0.0787, "cat_7": 0.0687,
}
LAGS = (1, 2, 3, 6, 12)


def _series():
    return Window.partitionBy(*PAIR).orderBy("year_month")


def _last(n: int):
    return _series().rowsBetween(1 - n, 0)


def in_window(demand: DataFrame, start: str, end: str) -> DataFrame:
    return demand.where(F.col("year_month").between(start, end))


def seasonal_index(demand: DataFrame, start: str, end: str) -> DataFrame:
    """Mean quantity per SKU and calendar month over the mean of the SKU's monthly means.

    ``demand`` is the zero-filled grid. Sums and counts travel as whole numbers.
    """
    month = month_of(F.col("year_month")).alias("month_int")
    per_month = in_window(demand, start, end).groupBy("item_code", month).agg(F.avg("net_quantity").alias("_m"))
    overall = per_month.groupBy("item_code").agg(F.avg("_m").alias("_all"))
    return per_month.join(overall, "item_code").select(
        "item_code", "month_int", F.try_divide("_m", "_all").alias("seasonal_index"))


def seasonal_index_of_sparse(demand: DataFrame, pairs: DataFrame, start: str, end: str) -> DataFrame:
    """The same index from non-zero months only.

    Every pair has one row per month, so a mean over the grid is a sum over the
    non-zero months divided by pairs x years; ``pairs`` counts pairs per SKU
    (item_code, n_pairs) and the grid itself is never built.
    """
    spark = demand.sparkSession
    months = spark.sql(f"""select month(m) month_int, count(*) n_years from (select explode(sequence(
        date'{start}-01', date'{end}-01', interval 1 month)) m) group by 1""")
    month = month_of(F.col("year_month")).alias("month_int")
    sums = in_window(demand, start, end).groupBy("item_code", month).agg(F.sum("net_quantity").alias("_q"))
    cells = pairs.crossJoin(F.broadcast(months)).join(sums, ["item_code", "month_int"], "left")
    mean = F.coalesce(F.col("_q"), F.lit(0)).cast("double") / (F.col("n_pairs") * F.col("n_years"))
    per_month = cells.select("item_code", "month_int", mean.alias("_m"))
    overall = per_month.groupBy("item_code").agg(F.avg("_m").alias("_all"))
    return per_month.join(overall, "item_code").select(
        "item_code", "month_int", F.try_divide("_m", "_all").alias("seasonal_index"))


def enriched_sku(continuity: DataFrame, classes: DataFrame, collapse_line: str = "prod_line3", growth_line: str = "prod_line17") -> DataFrame:
    """SKU lookup with the authoritative class, its code and product-line flags."""
    line = F.col("product_line")
    joined = continuity.drop("demand_class").join(classes.select("item_code", "demand_class"), "item_code", "left")
    return joined.select(
        "item_code", "demand_class",
        remap(F.col("demand_class"), CLASS_CODES).cast("tinyint").alias("demand_class_encoded"),
        F.col("activity_rate").alias("sku_activity_rate"), F.col("cv").alias("sku_cv"),
        (line == collapse_line).cast("tinyint").alias("is_structural_collapse"),
        (line == growth_line).cast("tinyint").alias("is_hyper_growth"),
        log1p_or_null(F.col("total_quantity")).alias("sku_log_total_qty"))


def territory_context(territory: DataFrame) -> DataFrame:
    """Last month's quantity and the three-month mean of each territory."""
    w = Window.partitionBy("territory_id").orderBy("year_month")
    q = F.col("net_quantity")
    return territory.select(
        "territory_id", "year_month", q.alias("terr_net_quantity"), F.col("net_sales").alias("terr_net_sales"),
        F.lag(q, 1).over(w).alias("terr_lag_qty_1m"), F.avg(q).over(w.rowsBetween(-2, 0)).alias("terr_roll_mean_qty_3m"))


def base_rows(demand: DataFrame, clusters: DataFrame, start: str, end: str) -> DataFrame:
    """Training window of the three modelled segments; of a filled grid the segments are joined before it is filled."""
    source = series.source_of(demand)
    if source is not None and source.keys == PAIR and source.span is None:
        return base_grid(source.sparse, clusters, source.bounds, start, end, by=["outlet_id"])
    joined = in_window(demand, start, end).join(clusters.select("outlet_id", "cluster_definition"), "outlet_id", "left")
    return joined.where(F.col("cluster_definition").isin(*CLUSTER_CODES))


def base_grid(
    sparse: DataFrame, clusters: DataFrame, bounds: DataFrame, start: str, end: str,
    carry: DataFrame | None = None, by: list[str] | None = None,
) -> DataFrame:
    """:func:`base_rows` from non-zero months.

    Segments are joined and other outlets dropped before the months are filled,
    so the join moves the small table only. So are the columns of ``carry`` (one row per outlet). ``by`` are
    those of the keys that place the rows.
    """
    from stockloom.operators.facts import DEMAND, fill_months

    kept = sparse.join(clusters.select("outlet_id", "cluster_definition"), "outlet_id").where(
        F.col("cluster_definition").isin(*CLUSTER_CODES))
    if carry is not None:
        kept = kept.join(carry, "outlet_id", "left")
    rows = fill_months(kept, PAIR, bounds, {c: 0 for c in DEMAND}, wide=True, by=by)
    return series.remember(in_window(rows, start, end), replace(series.source_of(rows), span=(start, end)))


def time_features(df: DataFrame, base_year: int = 2015, peak: int = 10, trough: int = 4) -> DataFrame:
    year, month = year_of(F.col("year_month")), month_of(F.col("year_month"))
    waves = {}
    for k in (1, 2, 3):
        angle = F.lit(2 * math.pi * k) * month / 12
        waves[f"sin_{k}"], waves[f"cos_{k}"] = F.sin(angle), F.cos(angle)
    return series.extend(df, {
        "year": year, "month_int": month, "months_elapsed": (year - base_year) * 12 + month, **waves,
        "is_peak_month": (month == peak).cast("tinyint"), "is_trough_month": (month == trough).cast("tinyint"),
    })


def _with_running(df: DataFrame, adds: dict[str, Column]) -> DataFrame:
    """Running totals ``_run_<name>`` from the start of each series.

    A trailing sum over n months is then one subtraction (:func:`_rolled`): every
    row is added once instead of once per frame it falls into. Whole numbers and
    decimals keep this exact.
    """
    upto = _series().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"_run_{n}": F.sum(c).over(upto) for n, c in adds.items()})


def _rolled(name: str, n: int, upto: int = 0) -> Column:
    """Trailing sum of ``n`` months that ends ``upto`` months back."""
    w = _series()
    c = F.col(f"_run_{name}")
    end = F.lag(c, upto).over(w) if upto else c
    return F.coalesce(end, F.lit(0)) - F.coalesce(F.lag(c, n + upto).over(w), F.lit(0))


def _rolled_by_windows(df: DataFrame) -> DataFrame:
    """``df`` with lags, trailing sums (names with ``_`` in front) and counts of rows, by windows."""
    w = _series()
    q, ret = F.col("net_quantity"), F.col("return_quantity")
    sales = F.col("net_sales")
    running = _with_running(df, {
        "rows": F.lit(1).cast("bigint"), "qty": q, "sq": q * q, "nonzero": (q > 0).cast("bigint"),
        "ret": ret, "shipped": F.col("gross_quantity") + ret, "sales": sales,
    })
    first = {}
    for n in LAGS:
        first[f"lag_qty_{n}m"] = F.lag(log1p_or_null(q), n).over(w)
        first[f"lag_sales_{n}m"] = F.lag(log1p_or_null(sales), n).over(w)
    for n in (3, 6, 12):
        first[f"roll_nonzero_count_{n}m"] = _rolled("nonzero", n)
        for name in ("qty", "sq", "sales"):
            first[f"_{name}_{n}"] = _rolled(name, n)
    for n in (3, 6):
        first[f"_ret_{n}"], first[f"_shipped_{n}"] = _rolled("ret", n), _rolled("shipped", n)
    first["roll_std_sales_6m"] = F.stddev_samp(sales.cast("double")).over(_last(6))
    first["_q1"], first["_q6"], first["_q12"] = (F.lag(q, n).over(w) for n in (1, 6, 12))
    return running.withColumns(first)


def _rolled_by_arrays(filled: series.Filled) -> series.Filled:
    """The columns of :func:`_rolled_by_windows` from running totals of a filled series."""
    first = {"_run_rows": filled.position() + 1}
    for n in LAGS:
        first[f"lag_qty_{n}m"] = F.log1p(filled.double("net_quantity", n))
        first[f"lag_sales_{n}m"] = F.log1p(filled.double("net_sales", n))
    for n in (3, 6, 12):
        first[f"roll_nonzero_count_{n}m"] = filled.trailing("event", n)
        first[f"_qty_{n}"], first[f"_sq_{n}"] = filled.trailing("net_quantity", n), filled.trailing("sq", n)
        first[f"_sales_{n}"] = filled.as_double("net_sales", filled.trailing("net_sales", n))
    for n in (3, 6):
        first[f"_ret_{n}"] = filled.trailing("return_quantity", n)
        first[f"_shipped_{n}"] = filled.trailing("gross_quantity", n) + first[f"_ret_{n}"]
    first["roll_std_sales_6m"] = F.get("_std6_net_sales", F.col("_k"))
    first["_q1"], first["_q6"], first["_q12"] = (filled.whole("net_quantity", n) for n in (1, 6, 12))
    return filled.add(first)


def lag_rolling_features(df: DataFrame) -> DataFrame:
    """Lags, rolling statistics, trend, return and price features.

    The rows are a zero-filled grid: quantities and sales are never NULL. A grid of ``fill_months`` is worked out on arrays.
    """
    filled = series.of(df, PAIR)
    rolled = _rolled_by_windows(df) if filled is None else _rolled_by_arrays(filled)
    means, second = _averages()
    if filled is not None:
        wide = rolled.add(means).add(second)
        hidden = [c for c in wide.frame.columns if c.startswith("_") and c not in filled.frame.columns]
        return replace(wide, frame=wide.frame.drop(*hidden)).rows()
    averaged = rolled.withColumns(means)
    return averaged.withColumns(second).drop(*[c for c in averaged.columns if c.startswith("_") and c not in df.columns])


def _averages() -> tuple[dict[str, Column], dict[str, Column]]:
    """Means and deviations from trailing sums, then ratios of those."""
    q, ret = F.col("net_quantity"), F.col("return_quantity")
    shipped, sales = F.col("gross_quantity") + ret, F.col("net_sales")
    means = {}
    for n in (3, 6, 12):
        k = F.least(F.col("_run_rows"), F.lit(n))
        s, sq = F.col(f"_qty_{n}"), F.col(f"_sq_{n}")
        means[f"roll_mean_qty_{n}m"] = s.cast("double") / k
        means[f"roll_mean_sales_{n}m"] = F.col(f"_sales_{n}").cast("double") / k
        # sample deviation from exact whole-number sums; NULL below two rows
        spread = (k * sq - s * s).cast("double")
        means[f"roll_std_qty_{n}m"] = F.when(k > 1, F.sqrt(F.try_divide(spread, (k * (k - 1)).cast("double"))))

    def over(top: str, bottom: str) -> Column:
        return F.col(top) / (F.col(bottom) + EPS)

    second = {f"roll_cv_qty_{n}m": over(f"roll_std_qty_{n}m", f"roll_mean_qty_{n}m") for n in (3, 6, 12)}
    second |= {
        "yoy_growth": (q - F.col("_q12")) / (F.col("_q12") + EPS),
        "momentum_ratio": over("roll_mean_qty_3m", "roll_mean_qty_6m"),
        "short_long_ratio": over("roll_mean_qty_3m", "roll_mean_qty_12m"),
        "trend_slope_approx": (F.col("_q1") - F.col("_q6")) / 5.0,
        "current_return_rate": ret / (shipped + EPS),
        "roll_return_rate_3m": over("_ret_3", "_shipped_3"),
        "roll_return_rate_6m": over("_ret_6", "_shipped_6"),
        "price_per_unit": sales.cast("double") / F.greatest(q, F.lit(1)),
    }
    return means, second


def lagged(df: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """``df`` with a whole-number column of ``n`` months ago."""
    filled = series.of(df, PAIR)
    if filled is not None:
        return filled.add({name: filled.whole(column, n)}).rows()
    return df.withColumn(name, F.lag(column, n).over(_series()))


ZERO_COLUMNS = ["months_since_last_purchase", "consecutive_zeros", "demand_event_rate_6m", "demand_event_rate_12m"]
TARGET_COLUMNS = ["target_qty_raw", "target_qty_log1p", "target_is_nonzero", "target_log1p_net_sales"]


def add_zero_inflation(df: DataFrame, exclude_current: bool = False) -> DataFrame:
    """Months since the last sale, zero-run position and event rates.

    The event rates include the current month unless ``exclude_current``. The
    zero run before the first sale starts at 0.
    """
    filled = series.of(df, PAIR)
    if filled is not None:
        return _zero_inflation_by_arrays(filled, exclude_current).rows()
    w = _series()
    event = F.col("net_quantity") > 0
    marked = _with_running(df, {"rows": F.lit(1).cast("bigint"), "event": event.cast("bigint")})
    pos = F.col("_run_rows") - 1
    # the position of the last sale never decreases, so a running maximum finds it
    last = F.max(F.when(event, pos)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    since = pos - F.col("_last")

    def rate(n: int) -> Column:
        past = F.col("_run_rows") - (1 if exclude_current else 0)
        return F.try_divide(_rolled("event", n, int(exclude_current)).cast("double"), F.least(past, F.lit(n)).cast("double"))

    # a run starts at its sale, so its position is the distance to the last sale
    run = F.coalesce(since, pos)
    return marked.withColumns({
        "_last": last, "demand_event_rate_6m": rate(6), "demand_event_rate_12m": rate(12),
    }).withColumns({
        "months_since_last_purchase": since.cast("bigint"),
        "consecutive_zeros": F.when(F.col("net_quantity") == 0, run).otherwise(0).cast("bigint"),
    }).drop("_run_rows", "_run_event", "_last")


def _zero_inflation_by_arrays(filled: series.Filled, exclude_current: bool) -> series.Filled:
    pos, skip = filled.position(), int(exclude_current)
    # the last sale is where the running count of sales took its present value
    last = F.when(filled.total("event") > 0, F.array_position(F.col("_p_event"), filled.total("event")) - 1)

    def rate(n: int) -> Column:
        past = (pos + 1 - skip).cast("double")
        return F.try_divide(filled.trailing("event", n, skip).cast("double"), F.least(past, F.lit(float(n))))

    wide = filled.add({
        "demand_event_rate_6m": rate(6), "demand_event_rate_12m": rate(12), "months_since_last_purchase": (pos - last).cast("bigint")})
    run = F.coalesce(F.col("months_since_last_purchase"), pos)
    return wide.add({"consecutive_zeros": F.when(F.col("net_quantity") == 0, run).otherwise(0).cast("bigint")})


def zero_inflation_features(df: DataFrame, exclude_current: bool = False) -> DataFrame:
    """The zero-inflation table: row key and four features."""
    return add_zero_inflation(df, exclude_current).select(*PAIR, "year_month", *ZERO_COLUMNS)


def add_targets(df: DataFrame, horizon: int = 2) -> DataFrame:
    """Quantity ``horizon`` months ahead: raw, log1p, event flag, and log1p of sales."""
    raw = F.col("target_qty_raw")
    after = {"target_qty_log1p": log1p_or_null(raw), "target_is_nonzero": (raw > 0).cast("tinyint")}
    filled = series.of(df, PAIR)
    if filled is not None:
        return filled.add({
            "target_qty_raw": filled.whole("net_quantity", -horizon), "target_log1p_net_sales": F.log1p(filled.double("net_sales", -horizon)),
        }).add(after).rows()
    w = _series()
    return df.withColumns({
        "target_qty_raw": F.lead("net_quantity", horizon).over(w),
        "target_log1p_net_sales": F.lead(log1p_or_null(F.col("net_sales")), horizon).over(w),
    }).withColumns(after)


def targets(df: DataFrame, horizon: int = 2) -> DataFrame:
    """The target table: row key and four targets."""
    return add_targets(df, horizon).select(*PAIR, "year_month", *TARGET_COLUMNS)


def join_features(
    base: DataFrame, outlets: DataFrame | None, sku: DataFrame, seasonal: DataFrame,
    category_rates: dict[str, float] | None = None, carry: list[str] | None = None,
) -> DataFrame:
    """Outlet, SKU and seasonal lookups, segment codes, category return rate and grid cell.

    ``carry`` names further columns of ``base`` to keep.
    """
    rows = base.select(*PAIR, "year_month", "month_int", "cluster_definition", "product_category", "roll_mean_sales_3m", "roll_mean_qty_3m", *list(carry or []))
    return with_lookups(rows, outlets, sku, seasonal, category_rates).drop("product_category", "roll_mean_sales_3m", "roll_mean_qty_3m")


def outlet_columns(outlets: DataFrame) -> DataFrame:
    """Features of outlets under the names they have in the matrix."""
    place = {"territory_id", "region", "province"}
    kept = [c for c in outlets.columns if c not in place | {"outlet_id", "total_net_sales"}]
    return outlets.select(
        "outlet_id", log1p_or_null(F.col("total_net_sales")).alias("outlet_total_net_sales_log"),
        *[F.col(c).alias(f"outlet_{c}") for c in kept])


def with_lookups(
    rows: DataFrame, outlets: DataFrame | None, sku: DataFrame, seasonal: DataFrame,
    category_rates: dict[str, float] | None = None, territory: DataFrame | None = None,
) -> DataFrame:
    """``rows`` with outlet, SKU and seasonal lookups, segment codes, category return rate and grid cell.

    With ``territory`` (monthly demand of territories) also the context of each row's territory and month.
    ``outlets`` is None for rows that carry :func:`outlet_columns` already.
    """
    rates = CATEGORY_RETURN_RATES if category_rates is None else category_rates
    if territory is not None:
        rows = rows.join(territory_context(territory), ["territory_id", "year_month"], "left")
    if outlets is not None:
        rows = rows.join(outlet_columns(outlets), "outlet_id", "left")
    joined = rows.join(sku, "item_code", "left").join(seasonal, ["item_code", "month_int"], "left")
    cluster = F.col("cluster_definition")
    code = remap(cluster, CLUSTER_CODES)
    return joined.withColumns({
        "cluster_encoded": code.cast("tinyint"),
        "is_power_outlet": (cluster == "Power").cast("tinyint"),
        "is_high_value_active": (cluster == "High-Value Active").cast("tinyint"),
        "is_low_value_sporadic": (cluster == "Low-Value Sporadic").cast("tinyint"),
        "category_return_rate": remap(F.col("product_category"), rates, 0.0) if rates else F.lit(0.0),
        "grid_cell": (code * 3 + F.col("demand_class_encoded")).cast("tinyint"),
        "price_per_unit_roll_3m": F.col("roll_mean_sales_3m") / (F.col("roll_mean_qty_3m") + EPS),
    })
