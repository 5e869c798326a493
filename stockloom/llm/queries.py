"""Registered queries of this subpackage: each applies its operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from stockloom.llm import decontaminate, language, nbest, outliers, packing, perplexity, phrases, prefix_trie, shards, simhash, suffixes, token_blocks, url_rules
from stockloom.llm.common import stage, stage_path, table

QUERIES = {}
CHECKS: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_url_filters(spark: SparkSession, d: str) -> DataFrame:
    return url_rules.judge(table(spark, d, "pages"), table(spark, d, "labels")).drop("url")


@query
def op2_token_blocks(spark: SparkSession, d: str) -> DataFrame:
    path = stage_path(spark, "tokens")
    token_blocks.write_tokens(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_blocks.token_digests(spark, path)


@query
def op3_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return language.identified(docs).select("doc_id", "held_out", "lang_pred", "score")


@query
def op4_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    out = outliers.judge(table(spark, d, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query
def op5_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, d, "documents"), shingle=4, radius=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query
def op6_suffix_array_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, d, "documents"), digest=True)


@query
def op7_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op8_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return perplexity.judge(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op9_sharding(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    tree = shards.Tree.even(40)
    grown = tree.grown(shards.Leaf(40, "region1", "rack7"))
    out = shards.assign(rows, "doc_id", tree, grown, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op10_sentencepiece_nbest(spark: SparkSession, d: str) -> DataFrame:
    return nbest.digest(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_phrase_mining(spark: SparkSession, d: str) -> DataFrame:
    return phrases.phrases(table(spark, d, "documents"), least=100, longest=5, top=2000)


CHECKS["op11_phrase_mining"] = phrases.sql()


@query
def op12_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    turns = prefix_trie.rebuilt(stage(prefix_trie.numbered(table(spark, d, "conversations"))), family=20, heads=4)
    return prefix_trie.trie(turns).drop(*prefix_trie.SUMS)


CHECKS["op12_prefix_trie"] = prefix_trie.sql()


@query
def op13_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)
