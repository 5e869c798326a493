"""Quality rules: base limits, and robust multivariate outliers.

Each text gets base counts and a vector of transformed statistics. Per group
(language and source; groups that are too small are pooled per language, then
all together) the location and scatter of the vectors are estimated by minimum
covariance determinant, and a text is rejected if its squared Mahalanobis
distance is beyond a chi-square quantile.

The estimate is the fast one: concentration steps from two deterministic starts
(medians with median deviations; plain means and covariances), the better
determinant wins, then one reweighting. A step needs the ``core`` share of a
group with the least distances. Distances are counted in buckets of a
logarithmic scale, together with the sums each bucket needs, so a step is one
grouped aggregation with map-side combine: no sort, no group in one task, and
the same result however rows are dealt. The core is all rows up to the bucket in
which the share is reached.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import split_words, stage

#: Characters that part words.
GAPS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
#: Statistics of a text, and the least standard deviation each is given. Shares are smoothed by
#: ``PRIOR`` words of ordinary text, so that short texts do not scatter more than long ones.
STATS = {"word_length": 0.04, "symbol_share": 0.05, "nonletter_share": 0.05, "upper_share": 0.05}
PRIOR, PRIOR_CHARS = 50, 250
N = len(STATS)
BUCKETS_PER_OCTAVE = 16


def repeated_words(w: Column, window: int = 5) -> Column:
    """Words of the array ``w`` in windows of that many words which occur twice or more in it.

    Windows are hashed, and hash and position packed into one number, the position
    in as many low bits as the text needs. In sorted order equal windows are then
    neighbours; neighbours are compared by their whole hashes. The positions of
    repeated windows are intervals of ``window`` words, of which the union is summed.
    """

    def let(value: Column, then) -> Column:
        return F.element_at(F.transform(F.array(value), then), 1)

    def count(hashes: Column) -> Column:
        bits = F.ceil(F.log2(F.size(hashes) + F.lit(1.0))).cast("int")
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        packed = F.sort_array(F.transform(hashes, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))))

        def spans(order: Column) -> Column:
            def same(x: Column, k: Column) -> Column:
                y = F.get(order, k)
                return F.coalesce(
                    (F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits))
                    & (F.get(hashes, x.bitwiseAND(mask).cast("int")) == F.get(hashes, y.bitwiseAND(mask).cast("int"))), F.lit(False))

            return F.transform(F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x.bitwiseAND(mask))

        def union(at: Column) -> Column:
            step = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
            return F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x)

        return let(packed, lambda order: let(F.sort_array(spans(order)), union))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, (i + k).cast("int")) for k in range(window)]))
    return F.when(F.size(w) > window, let(hashes, count)).otherwise(F.lit(0).cast("long"))


def _left(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and base_failed, and the vector ``STATS``.

    A null or wordless text has zero counts and fails the base limits.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    out = docs.select("doc_id", "lang", "source", text.alias("text"), split_words(text, GAPS).alias("w"), lines.alias("lines"))
    out = out.select(
        "doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"), _left("text", SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"), _left("text", r"[^\p{L}]+").alias("letters"), _left("text", r"[^\p{Lu}]+").alias("upper"),
    )
    chars = F.col("word_chars") + PRIOR_CHARS
    share = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)) / chars)
    return out.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.log(chars / (F.col("n_words") + PRIOR)).alias("word_length"), share(F.col("n_symbols").cast("double")).alias("symbol_share"),
        share((F.col("word_chars") - F.col("letters")).cast("double")).alias("nonletter_share"), share(F.col("upper").cast("double")).alias("upper_share"),
    )


def chi2_below(x: float, freedom: int) -> float:
    """Distribution function of chi-square for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def chi2_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, freedom) < p else (low, mid)
    return high


PAIRS = [(i, j) for i in range(N) for j in range(i + 1)]


def _sums() -> list[Column]:
    x = [F.col(c) for c in STATS]
    return [F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(N)], *[F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in PAIRS]]


def _estimate(sums: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    """Means m*, and the triangular root r* of the scatter with its determinant, from ``_sums``."""
    out = sums.select(*keys, "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(N)], *[f"q{i}{j}" for i, j in PAIRS])
    floor = list(STATS.values())
    cov = {(i, j): (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * factor for i, j in PAIRS}
    out = out.select(*keys, "n", *[f"m{i}" for i in range(N)], *[(c + floor[i] ** 2 if i == j else c).alias(f"c{i}{j}") for (i, j), c in cov.items()])
    return _rooted(out, keys)


def _rooted(out: DataFrame, keys: list[str]) -> DataFrame:
    for i, j in PAIRS:  # Cholesky's order: row by row
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"r{i}{k}") * F.col(f"r{j}{k}")
        out = out.withColumn(f"r{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"r{j}{j}"))
    det = F.lit(0.0)
    for i in range(N):
        det = det + 2 * F.log(F.col(f"r{i}{i}"))
    return out.select(*keys, "n", *[f"m{i}" for i in range(N)], *[f"r{i}{j}" for i, j in PAIRS], det.alias("log_det"))


def _with_distance(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    out = rows.join(estimates, "gid", how)
    for i, c in enumerate(STATS):
        rest = F.col(c) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"r{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"r{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, N)), F.col("z0") * F.col("z0"))
    return out.withColumn("distance", d2).drop(*[f"z{i}" for i in range(N)])


def _groups(rows: DataFrame, least: int) -> DataFrame:
    """(lang, source, gid): a group of its own from ``least`` rows on, else its language's pool, else the pool of the rest."""
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    pools = sizes.where(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("pool"))
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    pools = pools.select(F.col("lang").alias("pool_lang"), "pool")
    sizes = sizes.join(pools, F.col("lang").eqNullSafe(F.col("pool_lang")), "left")
    gid = F.when(F.col("n") >= least, F.to_json(F.array(text("lang"), text("source")))).when(F.col("pool") >= least, F.to_json(F.array(text("lang")))).otherwise("[]")
    return sizes.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), gid.alias("gid"))


def judge(docs: DataFrame, core: float = 0.75, steps: int = 5, least: int = 40, cut: float = 0.9999, weight_cut: float = 0.975) -> DataFrame:
    """``text_statistics`` of every row with gid, distance and kept.

    Rows that fail the base limits are not kept, and take no part in the
    estimates. If fewer than ``least`` rows remain in the last pool, there is no
    distance, and its rows are kept. Repeated rows count as often as they occur.
    Null languages and sources are groups like others; columns beyond doc_id,
    text, lang and source are not read. ``core`` is the share that the scatter
    rests on: up to 1 - core of a group may be junk.
    """
    stats = stage(text_statistics(docs.select("doc_id", "text", "lang", "source")))
    fit = stats.where(~F.col("base_failed"))
    groups = stage(_groups(fit, least))
    match = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    rows = stage(fit.join(groups, match).select("gid", *STATS))

    centre = rows.groupBy("gid").agg(F.count("*").alias("n"), *[F.percentile_approx(c, 0.5, 1000).alias(f"m{i}") for i, c in enumerate(STATS)])
    spread = rows.join(centre, "gid").groupBy("gid").agg(
        *[F.first(c).alias(c) for c in centre.columns if c != "gid"], *[F.percentile_approx(F.abs(F.col(c) - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i, c in enumerate(STATS)])
    floor = list(STATS.values())
    median = _rooted(spread.select("gid", F.lit("median").alias("start"), "n", *[f"m{i}" for i in range(N)], *[
        (F.pow(F.col(f"d{i}") * 1.4826, F.lit(2.0)) + floor[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]), ["gid", "start"])
    plain = _estimate(rows.groupBy("gid").agg(*_sums()), ["gid"]).withColumn("start", F.lit("plain"))
    estimates = stage(median.unionByName(plain))

    factor = core / chi2_below(chi2_quantile(core, N), N + 2)
    bucket = F.floor(F.log2(F.col("distance") + 1e-9) * BUCKETS_PER_OCTAVE).cast("long")
    for _ in range(steps):
        sums = _with_distance(rows, estimates).withColumn("bucket", bucket).groupBy("gid", "start", "bucket").agg(*_sums())
        group = Window.partitionBy("gid", "start")
        upto = F.coalesce(F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = sums.withColumn("upto", upto).withColumn("all", F.sum("n").over(group)).where(F.col("upto") < core * F.col("all"))
        kept = kept.groupBy("gid", "start").agg(*[F.sum(c).alias(c) for c in sums.columns if c not in ("gid", "start", "bucket")])
        estimates = stage(_estimate(kept, ["gid", "start"], factor))
    best = estimates.groupBy("gid").agg(F.min_by(F.struct(*[c for c in estimates.columns if c != "gid"]), F.struct("log_det", "start")).alias("e")).select("gid", "e.*").drop("start")
    near = _with_distance(rows, best).where(F.col("distance") <= chi2_quantile(weight_cut, N)).groupBy("gid").agg(*_sums())
    final = stage(_estimate(near, ["gid"], weight_cut / chi2_below(chi2_quantile(weight_cut, N), N + 2)))
    final = final.where(F.col("n") >= least / 2)

    judged = _with_distance(stats.join(groups, match, "left").drop("g_lang", "g_source"), final, "left")
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= chi2_quantile(cut, N)))
    return judged.select(*stats.columns, "gid", "distance", kept.alias("kept"))
