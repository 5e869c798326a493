"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.sources import staging
from stockloom.sources.staging import stage_path, stage_root

__all__ = ["free_name", "give_back", "lower_ascii", "released", "split_words", "stage", "stage_by", "stage_path", "stage_root", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spark's setting (4.1) by which the shuffle files of a query go when it has ended, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Only the GNU C library has it.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


@contextmanager
def _shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stage(df: DataFrame) -> DataFrame:
    """As ``staging.stage``; the shuffle files of the write, which nothing reads again, go at its end."""
    with _shuffle_files_removed(df.sparkSession):
        return staging.stage(df)


def stage_by(df: DataFrame, key: str) -> DataFrame:
    """As ``stage``, in buckets of ``key``: joins on it shuffle only their other side.

    There are ``spark.sql.shuffle.partitions`` buckets, of one file each.
    """
    spark = df.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"stage_{uuid.uuid4().hex}"
    with _shuffle_files_removed(spark):
        df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", stage_path(spark)).saveAsTable(name)
    return spark.table(name)


def give_back() -> None:
    """Return memory that Arrow and the C library (where it can) keep unused."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def released(run: Callable) -> Callable:
    """``run`` (for mapInArrow); when its task ends, memory kept unused goes back: workers wait for other stages."""
    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; texts without other letters take the quick built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, gaps: str) -> Column:
    """Words between runs of the characters ``gaps`` (a regular expression); null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gaps), "")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
