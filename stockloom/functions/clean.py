"""Text cleaning and small column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T


def snake_name(name: str) -> str:
    """One column name in snake_case; camel humps become separate words."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name.strip())
    joined = re.sub(r"[\s\-]+", "_", spaced.lower())
    return re.sub(r"\W", "", joined).strip("_")


def snake_columns(df: DataFrame) -> DataFrame:
    """Rename every column of ``df`` to snake_case."""
    return df.toDF(*map(snake_name, df.columns))


def snake_value(value: Column) -> Column:
    """Text value in snake_case: NULL stays NULL, camel humps are left alone."""
    trimmed = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    joined = F.regexp_replace(F.lower(trimmed), r"(?U)[\s\-]+", "_")
    return F.regexp_replace(F.regexp_replace(joined, r"(?U)\W", ""), r"^_+|_+$", "")


def snake_values(df: DataFrame) -> DataFrame:
    """Apply :func:`snake_value` to every string column, ids and dates included."""
    return df.select(*[
        snake_value(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema
    ])


def ids_to_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def signed_quantity(quantity: str = "quantity", kind: str = "document_type", returned: str = "return") -> Column:
    """Quantity with a minus sign on return lines."""
    return F.when(F.col(kind) == returned, -F.col(quantity)).otherwise(F.col(quantity))


def month_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def first_of(month: Column) -> Column:
    """First day of a ``YYYY-MM`` month."""
    return F.to_date(F.concat(month, F.lit("-01")))


def year_of(month: Column) -> Column:
    return F.substring(month, 1, 4).cast("int")


def month_of(month: Column) -> Column:
    return F.substring(month, 6, 2).cast("int")


def ratio(top: Column, bottom: Column) -> Column:
    """Double division that gives NULL for a zero divisor."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def log1p_or_null(value: Column) -> Column:
    return F.log1p(value.cast("double"))


def remap(value: Column, table: dict, default=None) -> Column:
    """Look a column up in a small fixed dictionary; misses give ``default``."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[value], F.lit(default))


def keep_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows where any of ``columns`` is NULL, NaN or infinite."""
    kept = df.dropna(subset=columns)
    for c in columns:
        kept = kept.where(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")))
    return kept


def fill_nulls(df: DataFrame, defaults: dict) -> DataFrame:
    """Replace NULLs by a per-column constant, decimals included."""
    types = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(types[c])) for c, v in defaults.items()})


def feature_columns(columns: list[str], target: str, dropped: dict[str, list[str]]) -> list[str]:
    """Model inputs: everything outside the dropped groups and the target itself."""
    banned = {c for group in dropped.values() for c in group} | {target}
    return [c for c in columns if c not in banned]


def plain_numbers(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for display and export."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
        for f in df.schema
    ])
