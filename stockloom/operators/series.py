"""Window features of zero-filled series, worked out on arrays instead of on sorted rows.

A filled grid has many times the rows of its non-zero months, and a window over it sorts all of them. Here
the non-zero months of a series are gathered in one row; running totals of every month of the series are
arrays of that row, and the months are exploded last. A lag is the difference of two neighbouring totals, a
trailing sum that of two totals n months apart, so every row of the grid takes a few array reads and no
exchange, sort or window follows the explode.

:func:`remember` notes on a filled frame what it was filled from; :func:`of` finds that again. Frames that
were changed since, or not filled here, have no note, and the operators use plain windows on them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

_NOTE = "_stockloom_filled"


@dataclass
class Source:
    """Non-zero months (``sparse``), the keys of a series, month bounds (one row of two dates) and empty values."""

    sparse: DataFrame
    keys: list[str]
    bounds: DataFrame
    defaults: dict
    span: tuple[str, str] | None = None
    by: list[str] | None = None


@dataclass
class Filled:
    """A frame with one row per series and month, its visible columns and its hidden running totals."""

    frame: DataFrame
    visible: list[str]
    scales: dict[str, int]
    at: Column | None = None

    def total(self, name: str, back: int = 0) -> Column:
        """Running total ``back`` months ago, NULL before the series."""
        return F.get(F.col(f"_p_{name}"), (F.col("_k") if self.at is None else self.at) - back)

    def whole(self, name: str, back: int = 0) -> Column:
        """The month's own value as a whole number (of the last decimal place), ``back`` months ago (ahead if negative)."""
        return self.total(name, back) - F.coalesce(self.total(name, back + 1), F.lit(0))

    def double(self, name: str, back: int = 0) -> Column:
        return self.as_double(name, self.whole(name, back))

    def as_double(self, name: str, whole: Column) -> Column:
        scale = self.scales.get(name, 0)
        return whole.cast("double") / float(10 ** scale) if scale else whole.cast("double")

    def trailing(self, name: str, n: int, upto: int = 0) -> Column:
        """Sum of the ``n`` months that end ``upto`` months back, as a whole number."""
        return F.coalesce(self.total(name, upto), F.lit(0)) - F.coalesce(self.total(name, n + upto), F.lit(0))

    def position(self) -> Column:
        """0-based position in the series."""
        return F.col("_k").cast("bigint")

    def add(self, columns: dict[str, Column]) -> Filled:
        new = [c for c in columns if c not in self.visible and not c.startswith("_")]
        return replace(self, frame=self.frame.withColumns(columns), visible=[*self.visible, *new])

    def rows(self) -> DataFrame:
        out = self.frame.select(*self.visible)
        setattr(out, _NOTE, self)
        return out


def remember(df: DataFrame, source: Source) -> DataFrame:
    setattr(df, _NOTE, source)
    return df


def source_of(df: DataFrame) -> Source | None:
    note = getattr(df, _NOTE, None)
    return note if isinstance(note, Source) else None


def of(df: DataFrame, keys: list[str]) -> Filled | None:
    """The arrays behind ``df``, if it was filled along series of ``keys``."""
    note = getattr(df, _NOTE, None)
    if isinstance(note, Filled):
        return note
    return _dense(note) if isinstance(note, Source) and note.keys == list(keys) else None


def extend(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df.withColumns(columns)`` that keeps what is known of the series; ``columns`` are computed row by row."""
    note = getattr(df, _NOTE, None)
    if isinstance(note, Source) and not set(columns) & set(df.columns):
        note = _dense(note)
    if isinstance(note, Filled) and not set(columns) & set(note.visible):
        return note.add(columns).rows()
    return df.withColumns(columns)


def month_number(text: Column) -> Column:
    return F.substring(text, 1, 4).cast("int") * 12 + F.substring(text, 6, 2).cast("int") - 1


def _walked(s: Source) -> DataFrame:
    """Non-zero months with the months they stand for: numbers ``_f`` to ``_t``, of which the own one may be left out."""
    from stockloom.operators.facts import spread

    ends = s.bounds.select(*[(F.year(c) * 12 + F.month(c) - 1).alias(n) for c, n in (("first_month", "_first"), ("last_month", "_last"))])
    series = Window.partitionBy(*s.keys).orderBy("year_month")
    here, before, after = (month_number(c) for c in (F.col("year_month"), F.lag("year_month").over(series), F.lead("year_month").over(series)))
    walked = spread(s.sparse, s.by or s.keys).crossJoin(F.broadcast(ends)).withColumns({"_h": here, "_before": before, "_next": after})
    first, last = F.when(F.col("_before").isNull(), F.col("_first")).otherwise(F.col("_h")), F.coalesce(F.col("_next") - 1, F.col("_last"))
    if s.span:
        start, end = (int(m[:4]) * 12 + int(m[5:7]) - 1 for m in s.span)
        first, last = F.greatest(first, F.lit(start)), F.least(last, F.lit(end))
    walked = walked.withColumns({"_f": first, "_t": last})
    real = F.coalesce((F.col("_h") >= F.col("_f")) & (F.col("_h") <= F.col("_t")), F.lit(False))
    return walked.withColumn("_real", real).withColumns({
        "_nb": F.when(F.col("_real"), F.col("_h") - F.col("_f")).otherwise(F.col("_t") - F.col("_f") + 1),
        "_na": F.when(F.col("_real"), F.col("_t") - F.col("_h") + 1).otherwise(0),
    })


def deviation(f: Filled, name: str, n: int, k: Column) -> Column:
    """Sample deviation of the last ``n`` months at position ``k``; NULL for one row."""
    rows = F.least(k + 1, F.lit(n))
    mean = f.as_double(name, f.trailing(name, n)) / rows
    squares = reduce(add, [F.coalesce((f.double(name, j) - mean) * (f.double(name, j) - mean), F.lit(0.0)) for j in range(n)])
    # few windows hold a sale at all
    return F.when(rows > 1, F.when(f.trailing("cells", n) == 0, F.lit(0.0)).otherwise(F.sqrt(squares / (rows - 1))))


def key_counts(s: Source) -> DataFrame:
    """Rows, repeated months and surplus rows of each series, counted before its months are exploded."""
    rows, _scales, _names = _arrays(s, [])
    months = rows.groupBy(*s.keys).agg(F.sort_array(F.flatten(F.collect_list("_months"))).alias("_m"))
    several = F.filter("_m", lambda m, at: F.get("_m", at - 1) == m)
    surplus = F.size("_m") - F.size(F.array_distinct("_m"))
    return months.select(F.size("_m").alias("n_rows"), F.when(surplus == 0, 0).otherwise(F.size(F.array_distinct(several))).alias("repeated_keys"), surplus.alias("surplus_rows"))


def _arrays(s: Source, measures: list[str]) -> tuple[DataFrame, dict[str, int], list[str]]:
    """One row per series with its months and the running totals of ``measures`` at each of them."""
    types = {f.name: f.dataType for f in s.sparse.schema}
    scales = {c: types[c].scale for c in measures if isinstance(types[c], T.DecimalType)}
    upto = Window.partitionBy(*s.keys).orderBy("year_month").rowsBetween(Window.unboundedPreceding, 0)

    def whole(c: str) -> Column:
        x = F.coalesce(F.col(c), F.lit(s.defaults[c]).cast(types[c]))
        return (x * 10 ** scales[c] if c in scales else x).cast("bigint")

    walked = _walked(s).withColumns({f"_v_{c}": F.when(F.col("_real"), whole(c)).otherwise(F.lit(0).cast("bigint")) for c in measures})
    adds = {c: F.col(f"_v_{c}") for c in measures} | {"cells": F.col("_real").cast("bigint")}
    if "net_quantity" in adds:
        q = F.col("_v_net_quantity")
        adds |= {"sq": q * q, "event": (q > 0).cast("bigint")}
    for c, x in adds.items():
        walked = walked.withColumn(f"_d_{c}", x)
    walked = walked.withColumns({f"_a_{c}": F.sum(f"_d_{c}").over(upto) for c in adds})
    parts = [F.col("year_month").alias("at"), *[F.col(f"_{c}").alias(c) for c in ("f", "t", "nb", "na")]]
    parts += [x.alias(n) for c in adds for n, x in ((f"b_{c}", F.col(f"_a_{c}") - F.col(f"_d_{c}")), (f"a_{c}", F.col(f"_a_{c}")))]
    fixed = [c for c in s.sparse.columns if c not in (*s.keys, "year_month", *s.defaults)]
    one = walked.groupBy(*s.keys, *fixed).agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("_s"))

    months = F.flatten(F.transform("_s", lambda x: F.when(x["f"] <= x["t"], F.sequence(x["f"], x["t"])).otherwise(F.array().cast("array<int>"))))
    # months without a date stand first and for all months before the first one, which therefore come twice
    months = F.when(F.col("_s")[0]["at"].isNull(), F.sort_array(months)).otherwise(months)

    def totals(c: str) -> Column:
        return F.flatten(F.transform("_s", lambda x: F.concat(F.array_repeat(x[f"b_{c}"], x["nb"]), F.array_repeat(x[f"a_{c}"], x["na"]))))

    rows = one.select(*s.keys, *fixed, months.alias("_months"), *[totals(c).alias(f"_p_{c}") for c in adds])
    return rows, scales, fixed


def _dense(s: Source) -> Filled:
    types = {f.name: f.dataType for f in s.sparse.schema}
    arrays, scales, _fixed = _arrays(s, list(s.defaults))
    if "net_sales" in s.defaults:
        arrays = arrays.withColumn("_std6_net_sales", F.transform(
            F.sequence(F.lit(0), F.size("_months") - 1), lambda k: deviation(Filled(arrays, [], scales, k), "net_sales", 6, k)))
    names = s.bounds.select(
        F.transform(F.sequence("first_month", "last_month", F.expr("interval 1 month")), lambda m: F.substring(m.cast("string"), 1, 7)).alias("_names"),
        (F.year("first_month") * 12 + F.month("first_month") - 1).alias("_zero"))
    rows = arrays.crossJoin(F.broadcast(names)).select("*", F.posexplode("_months").alias("_k", "_m"))
    rows = rows.withColumn("year_month", F.get(F.col("_names"), F.col("_m") - F.col("_zero")))
    out = Filled(rows, list(s.sparse.columns), scales)

    def own(c: str) -> Column:
        x = out.whole(c)
        if c in scales:
            x = x.cast("decimal(20,0)") * F.lit(1).cast("decimal(1,0)") / F.lit(10 ** scales[c]).cast("decimal(20,0)")
        return x.cast(types[c])

    return replace(out, frame=rows.withColumns({c: own(c) for c in s.defaults}))
