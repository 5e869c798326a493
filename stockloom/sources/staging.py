"""Stage tables: results that later steps read more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def stage_root(spark: SparkSession) -> str:
    """Shared folder for stage tables.

    It is the folder in ``spark.checkpoint.dir``. Where that is unset, a cluster
    uses a folder in its warehouse, which executors share as well, and a session
    in one process a temporary folder that goes when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stockloom-stages"
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="stockloom-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def stage_path(spark: SparkSession, kind: str = "stage") -> str:
    """A new path in the stage folder."""
    return f"{stage_root(spark)}/{kind}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the stage folder and read it back.

    Multi-pass operators (global ranks, exact quantiles) call this on their
    already aggregated input, so the facts are scanned once, and a lost executor
    costs a re-read of the stage files.
    """
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
