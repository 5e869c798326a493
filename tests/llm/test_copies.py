"""Work on copies of a text does not grow with their number."""

import random

from pyspark.sql import functions as F

from stockloom.llm import suffixes


def test_runs_of_a_text_do_not_grow_with_its_copies(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(900))
    other = "".join(rng.choice("abcdefgh ") for _ in range(700)) + text[:300]
    many = spark.range(3000, numPartitions=3).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    docs = many.union(spark.createDataFrame([(9000, other)], "doc_id long, text string"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"), F.col("text").cast("binary").alias("raw"))
    got = {r["size"]: [(x.start, x.end) for x in r.runs] for r in suffixes.repeats(texts).collect()}
    assert all(len(runs) == len(set(runs)) < 100 for runs in got.values())
    cut = suffixes.remove_repeats(docs).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    assert {tuple(r) for r in cut} == {(900, 900, 1, 3000), (1000, 300, 1, 1)}
