"""Quality classification by an interpolated modified Kneser-Ney model.

The model is of character n-grams of trusted texts. All its counts are Spark
tables: a scan emits the n-grams of the highest order with their counts,
combined per batch and per task; each lower order counts the different
n-grams one longer that end in it; contexts are sums over their n-grams; and
joins on context and on suffix give, for each n-gram, two numbers:

    gain  log p(last character | rest) - log backoff(rest) - log p(last | rest without its first)
    back  log backoff(the n-gram as a context)

The log probability of a character is then the sum of what its n-grams of every order
gain, and of the back of the contexts before it; n-grams never seen add nothing.
So a document's score is a sum over n-grams, in any order, and the table can be
joined in shards: each holds the n-grams of a hash range, at most about SHARD
of them, is sent to the tasks as a hash table, and adds its part to each document.
How many n-grams of a few characters there are is set by the writing in
the corpus rather than by its size, so shards stay few.

Folds: of the trusted texts, one in ``folds`` (by hash) is not counted; its
perplexities give each language's quantile, above which a document is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import stage

PAD = "\x02"
#: n-grams in one shard of the table, characters scored at once, and ids of trusted documents that may be broadcast.
SHARD, GROUP, BROADCAST_IDS = 2_000_000, 1 << 20, 2_000_000
U = np.uint64


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _longer(h: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each place, from those of n - 1 (``h``) and the characters ``c``."""
    x = (h[: len(c) - n + 1] + U(1)) * U(0x9E3779B97F4A7C15) + c[n - 1:]
    return (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)


def gram_hash(gram: str) -> int:
    c = _codes(gram)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, len(c) + 1):
        h = _longer(h, c, n)
    return int(h[0])


class GramTable:
    """Open-addressed table from n-gram hashes to (gain, back)."""

    def __init__(self, hashes: np.ndarray, gain: np.ndarray, back: np.ndarray):
        self.bits = max(4, int(len(hashes) * 4).bit_length())
        self.keys = np.zeros((1 << self.bits) + 64, np.uint64)
        self.values = np.zeros((len(self.keys), 2), np.float32)
        todo, step = np.arange(len(hashes)), 0
        while len(todo):  # each round, every free slot takes one of those that ask for it
            slot = self._slot(hashes[todo]) + step
            free = self.keys[slot] == 0
            taker = np.zeros(len(self.keys), np.int64)
            taker[slot[free]] = todo[free]
            won = free & (taker[slot] == todo)
            self.keys[slot[won]] = hashes[todo[won]]
            self.values[slot[won], 0], self.values[slot[won], 1] = gain[todo[won]], back[todo[won]]
            todo, step = todo[~won], step + 1
            if step >= 64:
                raise ValueError("too many n-grams with one hash")
        self.steps = step

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """(gain, back) of each hash, zeros where it is unknown."""
        slot = self._slot(h)
        key = self.keys[slot]
        out = self.values[slot]
        off = np.flatnonzero(key != h)
        out[off] = 0
        off = off[key[off] != 0]
        for step in range(1, self.steps):
            if not len(off):
                break
            slot = self._slot(h[off]) + step
            key = self.keys[slot]
            hit = key == h[off]
            out[off[hit]] = self.values[slot[hit]]
            off = off[~hit & (key != 0)]
        return out


def _groups(texts: list[str], order: int) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
    """(rows, padded texts in one, their starts, their ends) for up to GROUP characters at once; one text may be longer."""
    rows, held = [], 0
    for i in [*range(len(texts)), None]:
        if rows and (i is None or held + len(texts[i]) > GROUP):
            sizes = np.array([len(texts[r]) for r in rows], np.int64)
            ends = np.cumsum(sizes + order - 1)
            yield rows, "".join(PAD * (order - 1) + texts[r] for r in rows), ends - sizes, ends
            rows, held = [], 0
        if i is not None and texts[i]:
            rows.append(i)
            held += len(texts[i])


def ngrams(texts: DataFrame, order: int) -> DataFrame:
    """(gram, n) of all n-grams of ``order`` characters of ``text``, each text led by order - 1 pads. Null and empty texts have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, joined, starts, ends in _groups([t or "" for t in b.column("text").to_pylist()], order):
                c = _codes(joined)
                h = np.zeros(len(c), np.uint64)
                for n in range(1, order + 1):
                    h = _longer(h, c, n)
                own = np.ones(len(c), bool)  # n-grams that end in a character of a text
                for k in range(1, order):
                    own[starts - k] = False
                at = np.flatnonzero(own[order - 1:])
                _, first, count = np.unique(h[at], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([joined[i:i + order] for i in at[first].tolist()], pa.string()), pa.array(count, pa.int64())], names=["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts for counts 1, 2 and 3 or more, from the counts of counts."""
    row = counts.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(x, 1) for x in row)
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def train(texts: DataFrame, order: int = 4) -> DataFrame:
    """Table (gram, gain, back) of the model of ``texts``; no text gives no rows."""
    counts, tables = stage(ngrams(texts, order)), []
    by_order = {order: counts}
    for n in range(order - 1, 0, -1):
        by_order[n] = stage(by_order[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n")))
    below = None
    for n in range(1, order + 1):
        d = _discounts(by_order[n])
        grams = by_order[n].withColumn("context", F.substring("gram", 1, n - 1))
        sums = grams.groupBy("context").agg(F.sum("n").alias("total"), F.sum(_discount(F.col("n"), d)).alias("left"), F.count("*").alias("kinds"))
        sums = sums.select("context", "total", (F.col("left") / F.col("total")).alias("backoff"), "kinds")
        joined = grams.join(sums, "context")
        if below is None:  # the last level is even over all characters seen, and one that was not
            joined = joined.withColumn("p_below", 1 / (F.col("kinds") + 1.0))
        else:
            joined = joined.withColumn("suffix", F.substring("gram", 2, n - 1)).join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("p_below")), "suffix")
        seen = (F.col("n") - _discount(F.col("n"), d)) / F.col("total") + F.col("backoff") * F.col("p_below")
        scored = stage(joined.select("gram", seen.alias("p"), F.log(seen / (F.col("backoff") * F.col("p_below"))).alias("gain"), F.log(F.col("backoff") * F.col("p_below")).alias("floor")))
        # What is added for any character is added to the seen ones' gain at order 1.
        gain = F.log("p") if n == 1 else F.col("gain")
        tables.append(scored.select("gram", gain.alias("gain"), F.lit(0.0).alias("back")))
        if n > 1:
            tables.append(sums.select(F.col("context").alias("gram"), F.lit(0.0).alias("gain"), F.log("backoff").alias("back")))
        below = scored
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.union(t)
    return stage(whole.groupBy("gram").agg(F.sum("gain").alias("gain"), F.sum("back").alias("back")))


def log_probability(docs: DataFrame, model: DataFrame, order: int, unseen: float, shard: int = SHARD) -> DataFrame:
    """Per text of ``docs`` (doc_id, text): doc_id, hash, n_chars and logp, repeated rows once.

    ``unseen`` is the log probability of a character that the model never saw. The
    model is joined in shards of about ``shard`` n-grams; each scans the documents.
    """
    spark = docs.sparkSession
    n_shards = max(1, -(-model.count() // shard))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    parts = []
    for s in range(n_shards):
        # Single characters all go to the first shard, which knows by them what was never seen.
        own = model.where(F.when(F.length("gram") == 1, 0).otherwise(F.pmod(F.xxhash64("gram"), F.lit(n_shards))) == s).toArrow()
        hashes = np.array([gram_hash(g) for g in own.column("gram").to_pylist()], np.uint64)
        table = spark.sparkContext.broadcast(GramTable(hashes, own.column("gain").to_numpy(), own.column("back").to_numpy()))
        parts.append(keyed.mapInArrow(_scorer(table, order, unseen if s == 0 else 0.0, n_shards), "doc_id long, hash long, n_chars long, logp double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("doc_id", "hash").agg(F.max("n_chars").alias("n_chars"), F.sum("logp").alias("logp")) if n_shards > 1 else out.distinct()


def _scorer(table, order: int, unseen: float, n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            total = np.zeros(len(texts))
            for rows, joined, starts, ends in _groups(texts, order):
                c = _codes(joined)
                score = np.zeros(len(c) + 1)
                h = np.zeros(len(c), np.uint64)
                for n in range(1, order + 1):
                    h = _longer(h, c, n)
                    found = table.value.find(h)
                    if n == 1:
                        score[:-1] += np.where(found[:, 0] == 0, unseen, found[:, 0])
                    else:
                        score[n - 1:-1] += found[:, 0]
                    if n < order:
                        score[n:] += found[:, 1]
                total[rows] = np.add.reduceat(score, np.stack([starts, ends], 1).ravel())[::2]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), pa.array([len(t) for t in texts], pa.int64()), pa.array(total)], names=["doc_id", "hash", "n_chars", "logp"])

    return run


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a label of quality 1 that is not toxic. Their ids are broadcast up to BROADCAST_IDS of them, else the join is shuffled."""
    good = stage(labels.where((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))).select("doc_id").distinct())
    return docs.join(F.broadcast(good) if good.count() <= BROADCAST_IDS else good, "doc_id", "left_semi")


def judge(docs: DataFrame, labels: DataFrame, order: int = 4, folds: int = 5, quantile: float = 0.999, prior: int = 100) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, n_chars, perplexity, limit and kept.

    Perplexity is per character; ``prior`` characters of the language's average are
    added, so that short texts do not scatter more than long ones. ``limit`` is the
    ``quantile`` of the language over the trusted texts that were not counted; a
    language without any has the limit of all. Empty and null texts have the
    perplexity of their language's average, and are kept; without any trusted
    text, perplexity and limit are null, and all are kept. Columns beyond the three, and those of
    ``labels`` beyond doc_id, quality and toxic, are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    good = trusted(docs, labels)
    aside = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(folds)) == 0
    model = train(good.where(~aside), order)
    kinds = model.where(F.length("gram") == 1).count()
    unseen = float(np.log(1 / (kinds + 1.0) ** 2)) if kinds else 0.0
    scores = stage(log_probability(docs, model, order, unseen))
    rows = docs.select("doc_id", "lang", F.xxhash64("text").alias("hash"))
    rows = rows.join(scores.withColumnRenamed("doc_id", "id").withColumnRenamed("hash", "text_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash"))).drop("id", "text_hash")
    calm = trusted(rows, labels).where(aside & (F.col("n_chars") > 0))
    average = lambda x: x.agg((-F.sum("logp") / F.sum("n_chars")).alias("average"))
    means = stage(average(calm.groupBy("lang")).withColumnRenamed("lang", "l"))
    overall = average(calm.groupBy()).first()[0] if kinds else None
    same = F.col("lang").eqNullSafe(F.col("l"))
    rate = (F.col("average") * prior - F.col("logp")) / (F.col("n_chars") + prior)
    rated = stage(rows.join(means, same, "left").drop("l").withColumn("average", F.coalesce("average", F.lit(overall).cast("double"))).withColumn("perplexity", F.exp(rate)))
    calm = trusted(rated, labels).where(aside & (F.col("n_chars") > 0))
    level = F.percentile_approx("perplexity", quantile, 10000)
    limits = calm.groupBy("lang").agg(level.alias("own")).withColumnRenamed("lang", "l")
    whole = calm.agg(level).first()[0]
    out = rated.join(limits, same, "left").withColumn("limit", F.coalesce("own", F.lit(whole).cast("double")))
    return out.select("doc_id", "n_chars", "perplexity", "limit", F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(True)).alias("kept"))
