"""Fact tables: enriched lines, outlet x SKU, outlet, territory and outlet features.

The zero-filled grids are never joined to a cross product. Lines are summed per
key and month first (map-side combine), then each series is walked once with
``lead`` and the missing months are exploded in place, so the only data that is
shuffled is the non-zero months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.functions.clean import (
    first_of, ids_to_text, month_text, ratio, signed_quantity, snake_columns, snake_values,
)
from stockloom.operators import series
from stockloom.sources.staging import stage

PAIR = ["outlet_id", "item_code"]
PLACE = ["territory_id", "region", "district", "province"]
GOODS = ["product_category", "product_line", "brand"]
DEMAND = [
    "net_quantity", "net_sales", "gross_quantity", "gross_sales",
    "return_quantity", "return_sales", "n_invoices", "n_returns",
]
WINDOW_MONTHS = 12


# -- raw tables ---------------------------------------------------------------

def process_dimension(raw: DataFrame, id_columns: list[str] | None = None) -> DataFrame:
    """Clean names and values of a product or region map."""
    return ids_to_text(snake_values(snake_columns(raw)), list(id_columns or []))


def process_sales(
    raw: DataFrame,
    id_columns: list[str] = ("outlet_id", "territory_id"),
    drop: list[str] = ("is_direct_distributor",),
    returned: str = "return",
    renames: dict[str, str] | None = None,
) -> DataFrame:
    """Clean invoice lines: names, values, ids as text, signed quantity."""
    cleaned = ids_to_text(snake_values(snake_columns(raw)), list(id_columns)).drop(*drop)
    renames = {"documnet_number": "document_number"} if renames is None else renames
    named = cleaned.withColumnsRenamed(renames)
    return named.withColumn("quantity", signed_quantity(returned=returned))


def parse_month(sales: DataFrame) -> DataFrame:
    """Cleaned date text (``YYYY_MM_DD``) to a date, plus ``year_month``."""
    return with_month(sales.withColumn("document_date", F.to_date("document_date", "yyyy_MM_dd")))


def with_month(sales: DataFrame) -> DataFrame:
    return sales.withColumn("year_month", month_text(F.col("document_date")))


def attach_dimensions(sales: DataFrame, product: DataFrame, region: DataFrame) -> DataFrame:
    """Left joins to both maps; Spark broadcasts a map only below its size threshold."""
    return sales.join(product, "item_code", "left").join(region, "territory_id", "left")


def base_sales_enriched(sales: DataFrame, product: DataFrame, region: DataFrame) -> DataFrame:
    return attach_dimensions(parse_month(sales), product, region)


# -- months -------------------------------------------------------------------

def month_bounds(df: DataFrame) -> DataFrame:
    """One row: first and last month as dates."""
    return df.agg(
        first_of(F.min("year_month")).alias("first_month"), first_of(F.max("year_month")).alias("last_month")
    )


def month_spine(df: DataFrame) -> DataFrame:
    """Every month between the first and the last one, also those without rows."""
    months = F.explode(F.expr("sequence(first_month, last_month, interval 1 month)"))
    return month_bounds(df).select(months.alias("_m")).select(month_text(F.col("_m")).alias("year_month"))


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition by ``keys`` into the configured number of shuffle partitions.

    The explode that fills the months multiplies the rows after the shuffle.
    Without a fixed number, partitions would be merged by their size before the
    explode and a few tasks would build the whole grid.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fill_months(
    sparse: DataFrame, keys: list[str], bounds: DataFrame, defaults: dict[str, Column | int | str], wide: bool = False,
    by: list[str] | None = None,
) -> DataFrame:
    """Zero-fill monthly series between the bounds (one-row frame of two dates).

    ``wide`` keeps the full parallelism for tables with very many series, placed by ``by`` or all keys. What was filled is noted on the
    result, so that window features can be worked out before the months are exploded (``operators/series.py``).
    """
    source = series.Source(sparse, list(keys), bounds, defaults, by=by)
    sparse = spread(sparse, by or keys) if wide else sparse
    along = Window.partitionBy(*keys).orderBy("year_month")
    types = dict(sparse.dtypes)
    walked = (
        sparse.crossJoin(F.broadcast(bounds))
        .withColumns({
            "_here": first_of(F.col("year_month")),
            "_next": F.lead("year_month").over(along),
            "_prev": F.lag("year_month").over(along),
        })
        .withColumns({
            "_from": F.when(F.col("_prev").isNull(), F.col("first_month")).otherwise(F.col("_here")),
            "_to": F.coalesce(F.add_months(first_of(F.col("_next")), -1), F.col("last_month")),
        })
    )
    filled = walked.withColumn("_m", F.explode(F.expr("sequence(_from, _to, interval 1 month)")))
    real = F.col("_m") == F.col("_here")
    cells = []
    for c in sparse.columns:
        if c == "year_month":
            cells.append(F.substring(F.col("_m").cast("string"), 1, 7).alias(c))
        elif c in defaults:
            empty = F.lit(defaults[c]).cast(types[c])
            cells.append(F.when(real, F.coalesce(F.col(c), empty)).otherwise(empty).alias(c))
        else:
            cells.append(F.col(c))
    return series.remember(filled.select(*cells), source)


# -- outlet x SKU -------------------------------------------------------------

def line_measures() -> dict[str, Column]:
    """Monthly sums over lines; gross and return parts follow the sign of quantity."""
    q, s, kind = F.col("quantity"), F.col("net_sales"), F.col("document_type")
    return {
        "net_quantity": F.sum(q),
        "net_sales": F.sum(s),
        "gross_quantity": F.sum(F.when(q > 0, q)),
        "gross_sales": F.sum(F.when(q > 0, s)),
        "return_quantity": F.sum(F.when(q < 0, -q)),
        "return_sales": F.sum(F.when(q < 0, F.abs(s))),
        "n_invoices": F.count_if(kind == "invoice"),
        "n_returns": F.count_if(kind == "return"),
    }


def _smallest(columns: list[str]) -> Column:
    """Deterministic survivor: the smallest tuple whose first column is present."""
    return F.struct(F.col(columns[0]).isNull().alias("_absent"), *columns)


def pair_months(base: DataFrame) -> DataFrame:
    """Non-zero months of every outlet x SKU pair that has at least one invoice.

    Equal to the zero-filled table with the empty months left out, so any sum over
    it is the same; attributes are one tuple per pair.
    """
    dims = [c for c in PLACE + GOODS if c in base.columns]
    # grouping by the attributes keeps strings out of the aggregation buffers
    summed = spread(base.groupBy(*PAIR, "year_month", *dims).agg(*[c.alias(n) for n, c in line_measures().items()]), PAIR)
    pair = Window.partitionBy(*PAIR)
    sold = summed.select(
        *PAIR, "year_month", *DEMAND,
        F.sum("n_invoices").over(pair).alias("_sold"),
        F.min(_smallest(dims)).over(pair).alias("_home"),
    ).where("_sold > 0")
    # same partitioning as the window: no further exchange
    merged = sold.groupBy(*PAIR, "year_month", "_home").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DEMAND]
    )
    return merged.select(*PAIR, "year_month", *DEMAND, *[F.col(f"_home.{c}").alias(c) for c in dims])


def outlet_sku_monthly_demand(base: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Invoiced pairs x every month, zero-filled."""
    bounds = month_bounds(base) if bounds is None else bounds
    return fill_months(pair_months(base), PAIR, bounds, {c: 0 for c in DEMAND})


# -- outlet -------------------------------------------------------------------

ACTIVITY = [
    "n_invoices", "gross_quantity", "gross_sales", "n_returns",
    "return_quantity", "return_sales", "n_unique_skus", "n_unique_categories",
]


def modal_value(df: DataFrame, keys: list[str], value: str, name: str, weight: Column | None = None) -> DataFrame:
    """Most frequent non-null value per key; ties go to the smallest value. ``weight`` counts rows that stand for several."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count("*") if weight is None else weight).alias("_n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def home_attributes(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One attribute tuple per key, chosen as in :func:`pair_months`."""
    seen = df.select(*keys, *columns).distinct()
    best = seen.groupBy(*keys).agg(F.min(_smallest(columns)).alias("_home"))
    return best.select(*keys, *[F.col(f"_home.{c}").alias(c) for c in columns])


def outlet_cells(base: DataFrame) -> DataFrame:
    """Line sums per outlet, month, SKU, category, payment term and place, with the number of lines."""
    keys = ["outlet_id", "year_month", "item_code", "product_category", "payment_term", *PLACE]
    wanted = line_measures()
    return base.groupBy(*keys).agg(*[wanted[c].alias(c) for c in ACTIVITY if c in wanted], F.count("*").alias("_lines"))


def outlet_months(cells: DataFrame) -> DataFrame:
    """Months with at least one line per outlet, from :func:`outlet_cells`."""
    keys, types = ["outlet_id", "year_month"], dict(cells.dtypes)
    parts = {c: F.sum(c).cast(types[c]) for c in ACTIVITY if c in types}
    parts["n_unique_skus"] = F.countDistinct("item_code")
    parts["n_unique_categories"] = F.countDistinct("product_category")
    summed = cells.groupBy(*keys).agg(*[parts[c].alias(c) for c in ACTIVITY])
    return summed.join(modal_value(cells, keys, "payment_term", "primary_payment_term", F.sum("_lines")), keys, "left")


def outlet_monthly_activity(base: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Every outlet x every month, with the modal payment term.

    The lines are read once, into staged cells; sums, distinct counts, modal term,
    home and month bounds all come from those.
    """
    cells = stage(outlet_cells(base))
    bounds = month_bounds(cells) if bounds is None else bounds
    defaults = {**{c: 0 for c in ACTIVITY}, "primary_payment_term": "unknown"}
    filled = fill_months(outlet_months(cells), ["outlet_id"], bounds, defaults, wide=True)
    return filled.join(home_attributes(cells, ["outlet_id"], PLACE), "outlet_id", "left")


# -- territory, SKU, national -------------------------------------------------

def monthly_territory_demand(demand: DataFrame, region: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """Every territory of the map x every month.

    ``n_unique_skus`` counts outlet x SKU rows with an invoice (the historical
    meaning of the column); ``n_distinct_skus`` counts different SKUs among them.
    """
    months = month_spine(demand) if months is None else months
    sums = DEMAND[:6]
    invoiced = F.col("n_invoices") > 0
    agg = demand.groupBy("year_month", "territory_id").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.count_if(invoiced).alias("n_unique_skus"),
        F.countDistinct(F.when(invoiced, F.col("item_code"))).alias("n_distinct_skus"),
    )
    grid = region.select("territory_id").distinct().crossJoin(F.broadcast(months))
    filled = grid.join(agg, ["territory_id", "year_month"], "left")
    counts = [*sums, "n_unique_skus", "n_distinct_skus"]
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts}).join(region, "territory_id", "left")


def national_sku_demand(demand: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Six monthly sums per SKU; ``bounds`` adds the months nobody bought the SKU."""
    sums = DEMAND[:6]
    summed = demand.groupBy("item_code", "year_month").agg(*[F.sum(c).alias(c) for c in sums])
    return summed if bounds is None else fill_months(summed, ["item_code"], bounds, {c: 0 for c in sums})


def monthly_series(demand: DataFrame, by: list[str] | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """Monthly totals of the whole market, or one series per group of ``by``."""
    by = list(by or [])
    sums = ["net_quantity", "net_sales", "gross_quantity", "return_quantity"]
    summed = demand.groupBy(*by, "year_month").agg(*[F.sum(c).alias(c) for c in sums])
    if bounds is None:
        return summed
    if by:
        return fill_months(summed, by, bounds, {c: 0 for c in sums})
    one = summed.withColumn("_all", F.lit(1))
    return fill_months(one, ["_all"], bounds, {c: 0 for c in sums}).drop("_all")


# -- outlet features ----------------------------------------------------------

def last_months(activity: DataFrame, n: int = WINDOW_MONTHS) -> DataFrame:
    """Rows of the last ``n`` months of the table."""
    edge = activity.agg(first_of(F.max("year_month")).alias("_last"))
    since = F.substring(F.add_months("_last", 1 - n).cast("string"), 1, 7)
    edge = edge.select(since.alias("_since"))
    return activity.crossJoin(F.broadcast(edge)).where(F.col("year_month") >= F.col("_since")).drop("_since")


def outlet_momentum(recent: DataFrame) -> DataFrame:
    """Sales of the last three months over the earlier ones; 0 below six months of history."""
    per_outlet = Window.partitionBy("outlet_id")
    ranked = recent.select(
        "outlet_id", "gross_sales",
        F.row_number().over(per_outlet.orderBy("year_month")).alias("_pos"),
        F.count("*").over(per_outlet).alias("_n"),
    )
    late = F.col("_pos") > F.col("_n") - 3
    halves = ranked.groupBy("outlet_id").agg(
        F.coalesce(F.sum(F.when(late, F.col("gross_sales"))), F.lit(0)).alias("_late"),
        F.coalesce(F.sum(F.when(~late, F.col("gross_sales"))), F.lit(0)).alias("_early"),
        F.max("_n").alias("_n"),
    )
    usable = (F.col("_n") >= 6) & (F.col("_early") > 0)
    return halves.select(
        "outlet_id", F.when(usable, ratio(F.col("_late"), F.col("_early"))).otherwise(0.0).alias("momentum")
    )


def outlet_features(activity: DataFrame, cash: str = "cash", true_recency: bool = False) -> DataFrame:
    """Behaviour of each outlet over the trailing twelve months.

    ``recency_months`` is the historical constant 0 unless ``true_recency`` asks
    for the months since the last invoice (NULL if there is none in the table).
    """
    recent = last_months(activity)
    invoiced = F.col("n_invoices") > 0

    def per(top: Column, bottom: Column) -> Column:
        return F.coalesce(ratio(top, bottom), F.lit(0.0))

    active, returns = F.count_if(invoiced), F.sum("n_returns")
    core = recent.groupBy("outlet_id").agg(
        F.sum("gross_sales").alias("total_net_sales"),
        F.sum("gross_quantity").alias("total_quantity"),
        active.alias("active_months"),
        (active / F.lit(float(WINDOW_MONTHS))).alias("loyalty_ratio"),
        per(F.sum("n_invoices"), active).alias("avg_txn_per_active_month"),
        per(F.sum("gross_sales"), F.count_if(F.col("gross_sales") > 0)).alias("avg_net_sales_per_txn"),
        per(F.sum("gross_quantity"), F.count_if(F.col("gross_quantity") > 0)).alias("avg_qty_per_txn"),
        F.max("n_unique_skus").alias("n_unique_skus"),
        F.max("n_unique_categories").alias("n_unique_categories"),
        per(returns, F.count_if(F.col("n_returns") > 0) + returns).alias("return_rate"),
        F.lit(0).cast("bigint").alias("recency_months"),
        per(F.count_if(F.col("primary_payment_term") == cash), F.count("*")).alias("pct_cash_txn"),
    )
    out = core.join(outlet_momentum(recent), "outlet_id", "left").withColumns({
        "momentum": F.coalesce("momentum", F.lit(0.0)), "is_active": F.col("active_months") >= 1,
    })
    if true_recency:
        out = out.drop("recency_months").join(months_since_invoice(activity), "outlet_id", "left")
    return out.join(home_attributes(activity, ["outlet_id"], ["territory_id", "region", "province"]), "outlet_id", "left")


def months_since_invoice(activity: DataFrame) -> DataFrame:
    """Whole months between an outlet's last invoice and the end of the table."""
    end = activity.agg(first_of(F.max("year_month")).alias("_end"))
    # the month index keeps text out of the aggregation buffer
    index = F.year("_end") * 12 + F.month("_end")
    month = F.substring("year_month", 1, 4).cast("int") * 12 + F.substring("year_month", 6, 2).cast("int")
    last = activity.groupBy("outlet_id").agg(F.max(F.when(F.col("n_invoices") > 0, month)).alias("_last"))
    return last.crossJoin(F.broadcast(end)).select(
        "outlet_id", (index - F.col("_last")).cast("bigint").alias("recency_months")
    )


# -- audit --------------------------------------------------------------------

def key_audit(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Row count, number of repeated keys and surplus rows of a table; of a filled grid the months of each series are counted."""
    source = series.source_of(df)
    if source is not None and source.span is None and set(key) == {*source.keys, "year_month"}:
        return series.key_counts(source).agg(*[
            F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rows", "repeated_keys", "surplus_rows")
        ]).select(F.lit(name).alias("table_name"), "n_rows", "repeated_keys", "surplus_rows")
    per_key = df.groupBy(*key).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col("_n") > 1).alias("repeated_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("surplus_rows"),
    ).select(F.lit(name).alias("table_name"), "n_rows", "repeated_keys", "surplus_rows")


def null_audit(df: DataFrame, name: str) -> DataFrame:
    """Null count and share of every column."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    cells = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    long = counts.select("_n", F.expr(f"stack({len(df.columns)}, {cells}) as (column_name, null_count)"))
    return long.select(
        F.lit(name).alias("table_name"), "column_name", "null_count",
        F.coalesce(ratio(F.col("null_count"), F.col("_n")), F.lit(0.0)).alias("null_share"),
    )
