"""Column profiles, data-quality findings and readiness checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stockloom.functions.clean import ratio
from stockloom.operators.facts import month_spine
from stockloom.operators.relational import describe
from stockloom.sources.staging import stage

MAX_CATEGORIES = 50
TOP_VALUES = 30

# Severity and remedy of each finding.
FINDINGS = {
    "High nulls": ("High", "Drop column if low value; otherwise impute with median (numeric) or mode (categorical). Investigate upstream pipeline."),
    "Moderate nulls": ("Medium", "Impute with median/mean (numeric) or most-frequent (categorical). Flag non-random nulls for review."),
    "Single value": ("High", "Drop column; provides zero information. Audit data source."),
    "Near-constant": ("Medium", "Investigate whether column is meaningful; apply variance checks before modelling."),
    "Potential outliers": ("Medium", "Clip to [p1, p99] or apply IQR capping. Confirm whether values are errors or legitimate."),
    "High right skew": ("Low", "Apply log / sqrt / Box-Cox transform before algorithms that assume normality."),
    "High left skew": ("Low", "Apply log / sqrt / Box-Cox transform before algorithms that assume normality."),
    "Possible ID/free-text": ("Low", "Exclude from ML features; extract structured sub-fields if meaningful."),
    "Mis-typed numeric": ("Medium", "Cast with pd.to_numeric(..., errors='coerce') and inspect introduced nulls."),
    "Imbalanced categorical": ("Medium", "Use SMOTE, class-weighted models, or stratified splits. Confirm bias vs. reality."),
}
NUMERIC_HINTS = ["id", "count", "num", "qty", "amount"]


def value_frequencies(df: DataFrame) -> DataFrame:
    """(column_name, value, copies) over all columns, NULL included as a value.

    Counting per value before anything else is combined map-side, so a value that
    fills a third of the table is one partial row per task.
    """
    cells = ", ".join(f"'{c}', cast(`{c}` as string)" for c in df.columns)
    long = df.select(F.expr(f"stack({len(df.columns)}, {cells}) as (column_name, value)"))
    return long.groupBy("column_name", "value").agg(F.count("*").alias("copies"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def profile(df: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """One row per column: nulls, distinct values and, for numbers, the describe figures."""
    freq = value_frequencies(df) if frequencies is None else frequencies
    counts = freq.groupBy("column_name").agg(
        F.sum("copies").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("copies"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("n_unique"),
    )
    numbers = numeric_columns(df)
    if numbers:
        stats = describe(df, numbers).select(
            F.col("feature").alias("column_name"),
            *[F.round(c, 4).alias(n) for c, n in (
                ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "p25"), ("p50", "median"), ("p75", "p75"), ("max", "max"))],
        )
        counts = counts.join(stats, "column_name", "left")
    else:
        counts = counts.withColumns({c: F.lit(None).cast("double") for c in ("mean", "std", "min", "p25", "median", "p75", "max")})
    return counts.withColumns({
        "null_pct": F.round(ratio(F.col("null_count"), F.col("n_rows")) * 100, 2),
        "is_numeric": F.col("column_name").isin(numbers),
    })


def top_values(df: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """The most frequent values of non-numeric columns with few distinct values.

    Ties are ordered by value. At most ``MAX_CATEGORIES`` + 1 rows of a column
    reach one window group, because wider columns are filtered out before it.
    """
    from pyspark.sql import Window

    freq = value_frequencies(df) if frequencies is None else frequencies
    texts = [c for c in df.columns if c not in numeric_columns(df)]
    freq = freq.where(F.col("column_name").isin(texts))
    narrow = freq.groupBy("column_name").agg(F.count("value").alias("_u"), F.sum("copies").alias("_n")).where(
        F.col("_u") <= MAX_CATEGORIES)
    w = Window.partitionBy("column_name").orderBy(F.desc("copies"), F.asc_nulls_last("value"))
    ranked = freq.join(narrow, "column_name").withColumn("position", F.row_number().over(w))
    return ranked.where(F.col("position") <= TOP_VALUES).select(
        "column_name", "position", "value", F.col("copies").alias("n"),
        F.round(ratio(F.col("copies"), F.col("_n")) * 100, 2).alias("pct"),
    )


def findings(df: DataFrame) -> DataFrame:
    """Rule findings per column: (column_name, issue, detail, severity, remedy)."""
    freq = stage(value_frequencies(df))
    top = top_values(df, freq).where("position = 1").select(
        "column_name", F.coalesce("value", F.lit("nan")).alias("_top"), F.col("pct").alias("_top_pct"))
    p = profile(df, freq).join(top, "column_name", "left")
    c, number = F.col, F.col("is_numeric")
    iqr = c("p75") - c("p25")
    skewable = number & (c("mean") > 0) & (c("median") > 0)
    right, left = ratio(c("mean"), c("median")), ratio(c("median"), c("mean"))
    hinted = reduce(lambda a, b: a | b, [F.lower("column_name").contains(h) for h in NUMERIC_HINTS])
    unique_share = ratio(c("n_unique"), c("n_rows"))
    rules: list[tuple[str, Column, Column]] = [
        ("High nulls", c("null_pct") > 20, F.concat(c("null_pct").cast("string"), F.lit("% missing"))),
        ("Moderate nulls", (c("null_pct") > 5) & (c("null_pct") <= 20), F.concat(c("null_pct").cast("string"), F.lit("% missing"))),
        ("Single value", c("n_unique") == 1, F.lit("Only one unique value")),
        ("Near-constant", number & (c("std") == 0), F.lit("Standard deviation is zero")),
        ("Potential outliers", number & (iqr > 0) & ((c("max") - c("p75") > 3 * iqr) | (c("p25") - c("min") > 3 * iqr)),
         F.lit("Values beyond 3*IQR from quartiles")),
        ("High right skew", skewable & (right > 2), F.concat(F.lit("mean/median = "), F.round(right, 2).cast("string"))),
        ("High left skew", skewable & (left > 2), F.concat(F.lit("median/mean = "), F.round(left, 2).cast("string"))),
        ("Possible ID/free-text", ~number & (unique_share > 0.9),
         F.concat(F.lit("n_unique/n_rows > 0.9 ("), c("n_unique"), F.lit("/"), c("n_rows"), F.lit(")"))),
        ("Mis-typed numeric", ~number & (c("n_unique") <= 5) & hinted,
         F.concat(F.lit("Non-numeric with "), c("n_unique"), F.lit(" uniques, name suggests numeric"))),
        ("Imbalanced categorical", c("_top_pct") > 90,
         F.concat(F.lit("Top value "), c("_top"), F.lit(" at "), c("_top_pct").cast("string"), F.lit("%"))),
    ]
    candidates = F.array(*[
        F.struct(F.coalesce(hit, F.lit(False)).alias("hit"), F.lit(issue).alias("issue"), detail.alias("detail"),
                 F.lit(FINDINGS[issue][0]).alias("severity"), F.lit(FINDINGS[issue][1]).alias("remedy"))
        for issue, hit, detail in rules
    ])
    rows = p.select("column_name", F.explode(candidates).alias("f")).where("f.hit")
    return rows.select("column_name", "f.issue", "f.detail", "f.severity", "f.remedy")


def by_severity(found: DataFrame) -> DataFrame:
    level = F.when(F.col("severity") == "High", 0).when(F.col("severity") == "Medium", 1).otherwise(2)
    return found.orderBy(level, "column_name", "issue")


# -- months, signs, returns ---------------------------------------------------

def missing_months(base: DataFrame) -> DataFrame:
    """Months of the window without a single row."""
    return month_spine(base).join(base.select("year_month").distinct(), "year_month", "left_anti")


def missing_calendar_months(base: DataFrame, date: str = "document_date") -> DataFrame:
    """Calendar months 1..12 that never occur."""
    seen = base.select(F.month(date).alias("month_int")).distinct()
    return base.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month_int")).join(seen, "month_int", "left_anti")


def sign_violations(base: DataFrame) -> DataFrame:
    """Return lines whose quantity or sales are not negative."""
    returned = F.col("document_type") == "return"
    q, s = F.count_if(returned & (F.col("quantity") >= 0)), F.count_if(returned & (F.col("net_sales") >= 0))
    return base.agg(q.alias("quantity_violations"), s.alias("sales_violations")).withColumn(
        "passed", (F.col("quantity_violations") + F.col("sales_violations")) == 0)


def return_rates(base: DataFrame, by: Column | None = None, name: str = "year") -> DataFrame:
    """Returned over invoiced quantity in percent, overall or per group."""
    kind, q = F.col("document_type"), F.col("quantity")
    grouped = base.groupBy(by.alias(name)) if by is not None else base.groupBy()
    sums = grouped.agg(
        F.coalesce(F.sum(F.when(kind == "invoice", q)), F.lit(0)).alias("gross_qty"),
        F.coalesce(F.sum(F.when(kind == "return", F.abs(q))), F.lit(0)).alias("return_qty"),
        F.count_if(kind == "invoice").alias("n_invoices"),
        F.count_if(kind == "return").alias("n_returns"),
    )
    return sums.withColumn("return_rate_pct", ratio(F.col("return_qty"), F.col("gross_qty")) * 100)


def cardinality_check(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the fact against the number of dimension rows."""
    left = fact.agg(F.countDistinct(key).alias("n_fact"))
    right = dimension.agg(F.countDistinct(key).alias("n_dimension"))
    return left.crossJoin(right).select(
        F.lit(key).alias("key"), "n_fact", "n_dimension", (F.col("n_fact") <= F.col("n_dimension")).alias("passed"))


def null_shares(df: DataFrame) -> DataFrame:
    """Null share per column, only columns that have nulls, highest first."""
    from stockloom.operators.facts import null_audit

    return null_audit(df, "matrix").where("null_count > 0").drop("table_name").orderBy(F.desc("null_share"), "column_name")


def readiness(checks: DataFrame) -> DataFrame:
    """Add the verdict to (check_name, passed, blocking) rows: GO unless a blocking check fails."""
    verdict = checks.agg(F.min(F.when(F.col("blocking") & ~F.col("passed"), 0).otherwise(1)).alias("_ok"))
    return checks.crossJoin(F.broadcast(verdict)).withColumn(
        "verdict", F.when(F.col("_ok") == 1, "GO").otherwise("NO-GO")).drop("_ok")


def readiness_checks(sales: DataFrame, base: DataFrame, product: DataFrame, region: DataFrame) -> DataFrame:
    """The named checks of the baseline audit."""
    from stockloom.operators.relational import match_rate

    def row(frame: DataFrame, name: str, passed: Column, blocking: bool) -> DataFrame:
        return frame.select(F.lit(name).alias("check_name"), passed.alias("passed"), F.lit(blocking).alias("blocking"))

    rows = [
        row(match_rate(sales, product, "item_code"), "Product join match rate", F.col("passed"), True),
        row(match_rate(sales, region, "territory_id"), "Region join match rate", F.col("passed"), True),
        row(cardinality_check(sales, product, "item_code"), "Unique item codes within product map", F.col("passed"), False),
        row(cardinality_check(sales, region, "territory_id"), "Unique territories within region map", F.col("passed"), False),
        row(missing_months(base).agg(F.count("*").alias("n")), "Missing full months", F.col("n") == 0, True),
        row(missing_calendar_months(base).agg(F.count("*").alias("n")), "All 12 calendar months present", F.col("n") == 0, False),
        row(sign_violations(base), "Return sign convention", F.col("passed"), True),
    ]
    return reduce(DataFrame.unionByName, rows)
