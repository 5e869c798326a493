"""Column digests of large row sets: exact sums per group.

A digest covers every row. Doubles are scaled to whole numbers and summed in two
halves, so the result does not depend on the order of the rows and cannot
overflow. Values of a million and more (ratios over a nearly zero mean) enter by
their count and by the exact sum of their logarithms, to six places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LIMIT = 1_000_000
HALF = 24


def _exact_sum(whole: Column) -> Column:
    high = F.coalesce(F.sum(F.shiftright(whole, HALF)), F.lit(0)).cast("decimal(24,0)")
    low = F.coalesce(F.sum(whole.bitwiseAND(F.lit((1 << HALF) - 1).cast("bigint"))), F.lit(0)).cast("decimal(24,0)")
    return high * F.lit(1 << HALF).cast("decimal(10,0)") + low


def digest(df: DataFrame, keys: list[str], features: list[str], places: int = 7) -> DataFrame:
    types = dict(df.dtypes)
    cells = [F.count("*").alias("n_rows")]
    for f in features:
        cells.append(F.count(f).alias(f"n_{f}"))
        if types[f] == "double":
            x, scale = F.col(f), float(10 ** places)
            whole = F.when(F.abs(x) < LIMIT, F.floor(x * scale + 0.5))
            cells.append((_exact_sum(whole).cast("double") / scale).alias(f"s_{f}"))
            cells.append(F.count_if(F.abs(x) >= LIMIT).alias(f"big_{f}"))
            finite = (F.abs(x) >= LIMIT) & (F.abs(x) < F.lit(float("inf")))
            log = (F.signum(x) * F.floor(F.log(F.abs(x)) * 1e6 + 0.5)).cast("bigint")
            cells.append(F.coalesce(F.sum(F.when(finite, log)), F.lit(0)).alias(f"log_{f}"))
        else:
            cells.append(F.coalesce(F.sum(F.col(f).cast("bigint")), F.lit(0)).alias(f"s_{f}"))
    return df.groupBy(*keys).agg(*cells)


def digest_sql(source: str, keys: list[str], features: dict[str, bool], places: int = 7) -> str:
    """``features`` maps a name to True for doubles, False for whole numbers."""
    cells = ["count(*) AS n_rows"]
    for f, is_double in features.items():
        cells.append(f"count({f}) AS n_{f}")
        if is_double:
            scale = f"1e{places}::DOUBLE"
            cells.append(f"coalesce(sum(CASE WHEN abs({f}) < {LIMIT} THEN TRY_CAST(floor({f} * {scale} + 0.5) AS BIGINT) END), 0)::DOUBLE / {scale} AS s_{f}")
            cells.append(f"count(*) FILTER (WHERE abs({f}) >= {LIMIT}) AS big_{f}")
            cells.append(f"coalesce(sum(CASE WHEN abs({f}) >= {LIMIT} AND isfinite({f}) THEN (sign({f}) * floor(ln(abs({f})) * 1e6::DOUBLE + 0.5))::BIGINT END), 0)::BIGINT AS log_{f}")
        else:
            cells.append(f"coalesce(sum({f}::BIGINT), 0)::BIGINT AS s_{f}")
    return f"SELECT {', '.join(keys)}, {', '.join(cells)} FROM {source} GROUP BY ALL"
