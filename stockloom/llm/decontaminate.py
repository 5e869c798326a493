"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of its words (an item shorter than a
window is one window). A window is the ordered list of its shingles. It can
occur in a document only if each of its shingles does, so a prefix of one
shingle is enough to find candidates: the one that is rarest in the documents.

1. One scan of the documents explodes their shingle hashes and keeps those the
   benchmark has, with their positions. Words never leave the row.
2. The kept hits are counted per shingle (that is the order by rarity), and each
   window's rarest shingle is joined with the hits: the hit's position and the
   shingle's place in the window give the only possible start. Starts before
   the text or windows that would end behind it fall to the positional and
   length bounds.
3. Candidates are verified: every shingle of the window must be a hit at its place.

Benchmark shingles are broadcast only up to ``BROADCAST_ROWS`` distinct ones (16
bytes each); beyond that the scan's join is shuffled, and adaptive execution splits
frequent shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import lower_ascii, split_words, stage

#: Everything but digits, a-z (texts are lower-cased) and characters beyond ASCII parts words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Distinct benchmark shingles that may be broadcast.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return split_words(lower_ascii(text), GAPS)


def _shingles(w: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words, seeded with the length."""
    return F.when(
        F.size(w) >= length,
        F.transform(F.sequence(F.lit(1), F.size(w) - length + 1), lambda i: F.xxhash64(F.lit(length), *[F.element_at(w, (i + k).cast("int")) for k in range(length)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item_id, window, n, length, place, shingle): the shingles of all distinct windows."""
    own = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    own = own.withColumn("n", F.least(F.size("w"), F.lit(window)))
    own = own.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    own = own.select("item_id", F.slice("w", F.col("at"), F.col("n")).alias("w"), "n").withColumn("length", F.least("n", F.lit(shingle)))
    hashes = F.coalesce(*[F.when(F.col("length") == k, _shingles(F.col("w"), k)) for k in range(1, shingle + 1)])
    own = own.select("item_id", F.concat_ws(" ", "w").alias("window"), "n", "length", hashes.alias("hashes")).distinct()
    return own.select("item_id", "window", "n", "length", F.posexplode("hashes").alias("place", "shingle"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash, n_words, n_hit, items (sorted item_ids as strings).

    ``docs`` and ``benchmark`` (item_id, text) may have more columns; they are
    not read. Null and wordless texts have no words and no hits; null items and
    items without a word have no windows. Repeated rows each give their row,
    equal texts of one doc_id with equal results. Items with a null item_id
    count as hits, but are not named.
    """
    items = stage(_windows(benchmark.select("item_id", "text"), window, shingle))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most ``shingle`` numbers
    wanted = items.select("shingle").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    # One row for each document (place -1, its number of words) and one for each of its shingles.
    w = F.col("w")
    rows = [F.array(F.struct(F.lit(-1).alias("at"), F.size(w).cast("long").alias("shingle")))]
    rows += [F.transform(_shingles(w, k), lambda h, i: F.struct(i.alias("at"), h.alias("shingle"))) for k in lengths]
    scan = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    scan = scan.select("doc_id", "text_hash", F.explode(F.concat(*rows)).alias("x")).select("doc_id", "text_hash", "x.*")
    found = scan.join(wanted.withColumn("known", F.lit(True)), "shingle", "left").where("at < 0 or known")
    found = stage(found.select("doc_id", "text_hash", "at", "shingle"))
    sizes = found.where("at < 0").select("doc_id", "text_hash", F.col("shingle").alias("n_words"))
    hits = found.where("at >= 0").distinct()

    rarity = hits.groupBy("shingle").agg(F.count("*").alias("seen"))
    prefix = items.join(rarity, "shingle").groupBy("item_id", "window", "n").agg(
        F.min_by(F.struct("place", "shingle"), F.struct("seen", "place")).alias("rare"), F.count("*").alias("known"), F.first("length").alias("length"))
    prefix = prefix.where(F.col("known") == F.col("n") - F.col("length") + 1).select("window", "n", "length", "rare.*").distinct()
    bounds = sizes.distinct()
    start = F.col("at") - F.col("place")
    candidates = (
        hits.join(prefix, "shingle").select("doc_id", "text_hash", "window", "n", "length", start.alias("start")).where("start >= 0")
        .join(bounds.withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
        .where("start + n <= n_words").drop("id", "hash", "n_words")
    )
    parts = items.select("window", "place", "shingle").distinct()
    asked = candidates.join(parts, "window").withColumn("at", F.col("start") + F.col("place"))
    held = asked.join(hits.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("at").alias("there"), F.col("shingle").alias("same")),
                      F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")) & (F.col("at") == F.col("there")) & (F.col("shingle") == F.col("same")))
    whole = held.groupBy("doc_id", "text_hash", "window", "n", "length", "start").agg(F.count("*").alias("found")).where(F.col("found") == F.col("n") - F.col("length") + 1)
    whole = stage(whole.select("doc_id", "text_hash", "window", "n", "start"))

    covered = whole.select("doc_id", "text_hash", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("word")).distinct()
    n_hit = covered.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit"))
    named = whole.select("doc_id", "text_hash", "window").distinct().join(items.select("item_id", "window").distinct(), "window")
    named = named.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = n_hit.join(named.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "items"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    both = both.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "n_hit", "items")
    return sizes.join(both, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
