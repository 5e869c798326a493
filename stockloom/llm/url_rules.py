"""URL filters: fixed host rules, and association rules mined from labels.

The association rules: urls of labelled pages become sets of tokens, FP-growth
finds the token combinations that are frequent among them, and a combination
becomes a block rule if enough urls have it (support) and enough of those are
labelled bad (confidence), unless a shorter rule inside it is as confident. All
tokens of a url take part. What is left out of the search cannot change its
result: tokens whose bad urls are too few for any rule, tokens of which every
url is bad (each is a rule alone, and implies all longer ones), and all but one of the
tokens that the same labelled urls have. Such tokens are one item, which a url has
if it has any of them.

Matching uses an inverted index: a rule is posted under the rarest of its tokens
only, a url's tokens look up postings, and the rest of the rule is then checked
inside the row. Each distinct url is matched once; frequent tokens and urls
meet their partners in plain equi-joins, whose skew adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import UPPER, LOWER, stage

#: The rules of the contract. Each fits its host and that host's subdomains.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
BAD = "label bad"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): A-Z of the host lower-cased; both empty without ``://``. The path ends at ? or #."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        answer = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, answer) if out is None else out.when(fits, answer)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url: runs of letters and digits, those of host and of the rest kept apart."""
    host, _ = url_parts(url)
    rest = F.regexp_replace(url, r"^.*?://[^/?#]*", "")
    cut = lambda c, mark: F.transform(F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), ""), lambda t: F.concat(F.lit(mark), t))
    return F.array_distinct(F.concat(cut(host, "h:"), cut(rest, "p:")))


def items(known: DataFrame, support: float, confidence: float, n: int) -> DataFrame:
    """(token, item, n, bad) of the tokens that a rule may have; ``known`` is (row, tokens, bad), of ``n`` rows.

    A rule has support * n urls or more, of which confidence or more are bad. Tokens of the
    same urls (equal counts and two 64-bit sums of row hashes) share the item of the least token.
    """
    mark = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "row"))
    same = ["n", "bad", "x", "y"]
    counts = known.select("row", F.explode("tokens").alias("token"), "bad").groupBy("token").agg(
        F.count("*").alias("n"), F.sum("bad").alias("bad"), mark("x").alias("x"), mark("y").alias("y"))
    counts = stage(counts.where((F.col("n") >= support * n) & (F.col("bad") >= support * confidence * n * (1 - 1e-9))))
    return stage(counts.join(counts.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item", "n", "bad"))


def mine(pages: DataFrame, labels: DataFrame, support: float = 0.005, confidence: float = 0.6) -> DataFrame:
    """Block rules (tokens, members, anchor, confidence, support) from the labelled pages.

    Pages (page_id, url) meet labels (doc_id, quality, toxic) by id; a url is bad
    if its label has quality 0 or toxic 1, with nulls as not bad. ``support``
    and ``confidence`` are the least share of labelled urls that have the tokens,
    and of those the least share that is bad. ``members`` are, for each of a rule's ``tokens``, the
    tokens that the same labelled urls have: any of them stands for it. ``anchor`` is
    the rarest of ``tokens``. Null urls and unlabelled pages are not mined. No
    labelled page, or none that is bad, gives no rules.
    """
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    known = pages.where("url is not null").select("page_id", "url").join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id")
    known = stage(known.select(F.monotonically_increasing_id().alias("row"), url_tokens(F.col("url")).alias("tokens"), "bad"))
    n = known.count()
    frequent = items(known, support, confidence, n)
    heads = frequent.where(F.col("token") == F.col("item")).drop("token")
    searched = heads.where(F.col("bad") < F.col("n"))
    met = known.select("row", "bad", F.explode("tokens").alias("item")).join(searched.select("item"), "item")
    baskets = met.groupBy("row").agg(F.collect_list("item").alias("own"), F.first("bad").alias("bad"))
    baskets = baskets.select(F.concat("own", F.when(F.col("bad") == 1, F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    # FP-growth's support is a share of the baskets: of all known rows here, those without items included.
    baskets = stage(known.select("row").join(met.select("row").distinct(), "row", "left_anti").select(F.array().cast("array<string>").alias("items")).union(baskets))
    model = FPGrowth(itemsCol="items", minSupport=max(support * confidence * (1 - 1e-9), 1e-9), minConfidence=confidence * (1 - 1e-9)).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", (F.col("support") / F.col("confidence")).alias("support")).where(F.col("support") >= support * (1 - 1e-9))
    alone = heads.where(F.col("bad") == F.col("n")).select(F.array("item").alias("tokens"), F.lit(1.0).alias("confidence"), (F.col("n") / F.lit(float(max(n, 1)))).alias("support"))
    rules = stage(rules.union(alone))
    longer = rules.where(F.size("tokens") > 1).select(F.col("tokens").alias("whole"), F.col("confidence").alias("c"), F.explode("tokens").alias("first"))
    shorter = rules.select("tokens", "confidence", F.col("tokens")[0].alias("first"))
    implied = longer.join(shorter, "first").where((F.size("tokens") < F.size("whole")) & (F.size(F.array_except("tokens", "whole")) == 0) & (F.col("confidence") >= F.col("c"))).select(F.col("whole").alias("tokens")).distinct()
    rules = rules.join(implied, "tokens", "left_anti")
    members = frequent.groupBy("item").agg(F.sort_array(F.collect_list("token")).alias("members"), F.first("n").alias("n"))
    found = rules.select("tokens", F.explode("tokens").alias("item")).join(members, "item").groupBy("tokens").agg(
        F.array_sort(F.collect_list(F.struct("item", "members"))).alias("m"), F.min_by("item", F.struct("n", "item")).alias("anchor"))
    return stage(rules.join(found.withColumn("members", F.col("m.members")).drop("m"), "tokens"))


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls of ``pages`` that some rule fits: url, url_rule (tokens), confidence; the most confident, then best supported rule."""
    names = rules.select(F.explode(F.arrays_zip("tokens", "members")).alias("z")).select(F.col("z.tokens").alias("item"), F.explode("z.members").alias("token")).distinct()
    urls = pages.where("url is not null").select("url").distinct().withColumn("token", F.explode(url_tokens(F.col("url"))))
    own = urls.join(names, "token").groupBy("url").agg(F.collect_set("item").alias("own"))
    hits = own.withColumn("anchor", F.explode("own")).join(rules, "anchor").where(F.size(F.array_except("tokens", "own")) == 0)
    best = F.max_by(F.struct("tokens", "confidence"), F.struct("confidence", "support", F.concat_ws(" ", "tokens").alias("name")))
    return hits.groupBy("url").agg(best.alias("best")).select("url", F.concat_ws(" ", "best.tokens").alias("url_rule"), "best.confidence")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, **mining) -> DataFrame:
    """Per row of ``pages``: page_id, url, host, path, rule, verdict, url_rule, confidence.

    A fixed rule that fits decides; else the mined rules do: block if one fits,
    else allow. Null urls and urls without ``://`` have an empty host and path;
    null urls fit no rule and are allowed. Repeated rows each give their row.
    """
    pages = pages.select("page_id", "url")
    mined = match(pages, mine(pages, labels, **mining))
    host, path = url_parts(F.col("url"))
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path")).join(mined, "url", "left")
    out = out.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("url_rule").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "url", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "url_rule", "confidence")
