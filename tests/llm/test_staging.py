"""Shuffle files and joins of stage tables."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from stockloom.llm import similar, suffixes
from stockloom.llm.common import CLEANUP, stage, stage_by


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {blocks.apply(i).getName() for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle_")}


def test_staging_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    rows = spark.range(5000).withColumn("key", F.col("id") % 7)
    staged = [write(rows.repartition("key").groupBy("key").agg(F.count("*").alias("n"))) for write in (stage, lambda df: stage_by(df, "n"))]
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP) == setting
    for s in staged:
        assert {r.key: r.n for r in s.collect()} == {k: len(range(k, 5000, 7)) for k in range(7)}


def test_texts_are_not_shuffled_to_pick_some(spark):
    docs = spark.createDataFrame([(i, f"{' '.join(f'w{i}x{k}' for k in range(20))}") for i in range(50)] + [(50, " ".join(f"w1x{k}" for k in range(20)))], "doc_id long, text string")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = similar.one_of_each(docs)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # of the rows that go
        assert {r.doc_id for r in left.collect()} == {*range(50)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_memory_of_arrow_goes_back_when_a_task_ends(monkeypatch):
    calls = []
    pool = type("Pool", (), {"release_unused": lambda self: calls.append(1)})()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    batch = pa.RecordBatch.from_pydict({"node": [1], "text": ["a b c"]})
    for run in (similar._sketches(5), suffixes._find(200)):
        rows = run(iter([batch] if run.__qualname__.startswith("_sketches") else []))
        before = len(calls)
        list(rows)
        assert len(calls) == before + 1
