"""URL filters, quality rules, decontamination and sharding against plain versions."""

import hashlib
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stockloom.llm import decontaminate, outliers, queries, shards, url_rules

from . import brute

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, hash string"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# -- op1 ----------------------------------------------------------------------

URLS = [
    "http://a.example.com/en/x", "https://www.example.com/en/", "http://WWW.Example.com/fr/", "https://x.net/es/1?q", "http://net/fr/#", "ftp://net/es",
    "http://example.org", "no scheme", "", None, "http://", "x://notcom/", "http://com", "http://com/", "http://a.com?b/en/", "http://b.net/ES/", "HTTP://u:p@c.com:80/en/", "http://b.net/es/", "http://b.net/es/",
]


def test_host_path_and_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in rows_of(url_rules.judge(pages, labels))}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = brute.host_path(u)
        verdict, rule = brute.fixed_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow"), u


def test_rules_are_mined_and_matched(spark):
    rng = random.Random(5)
    pages, labels = [], []
    for i in range(600):
        spam = i % 3 == 0
        url = f"http://{'casino' if spam else 'news'}.site{rng.randint(0, 4)}.org/{'win' if spam or i % 7 == 0 else 'read'}/{i}"
        pages.append((i, url))
        labels.append((i, 0 if spam else 1, None))
    pages += [(1000, "http://casino.other.org/win/now"), (1001, "http://casino.other.org/home"), (1002, "http://news.other.org/win"), (1003, None), (1000, "http://casino.other.org/win/now")]
    p, q = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = rows_of(url_rules.mine(p, q, support=0.05, confidence=0.9))
    tokens = {r["page_id"]: r["t"] for r in rows_of(p.where("url is not null").select("page_id", url_rules.url_tokens(F.col("url")).alias("t")))}
    bad = {i for i, quality, _ in labels if quality == 0}
    assert rules
    for r in rules:  # confidence and support, counted plainly
        fits = [i for i in range(600) if set(r["tokens"]) <= set(tokens[i])]
        assert r["confidence"] == pytest.approx(len(bad & set(fits)) / len(fits)) and r["confidence"] >= 0.9
        assert r["support"] == pytest.approx(len(fits) / 600) and r["support"] >= 0.05 and r["anchor"] in r["tokens"]
    got = rows_of(url_rules.judge(p, q, support=0.05, confidence=0.9))
    assert len(got) == len(pages)
    for r in got:
        fits = r["url"] is not None and any(set(x["tokens"]) <= set(tokens[r["page_id"]]) for x in rules)
        assert r["verdict"] == ("block" if fits else "allow")
    assert {r["page_id"]: r["verdict"] for r in got}[1000] == "block"


def plain_rules(baskets, bad, support, confidence):
    """{tokens: confidence} of all rules that no shorter rule implies, from every frequent set of tokens."""
    n, rows = len(baskets), {}
    for i, b in enumerate(baskets):
        for t in b:
            rows[t] = rows.get(t, 0) | 1 << i
    wrong = sum(1 << i for i in bad)
    found, queue = {}, [((), (1 << n) - 1)]
    while queue:
        own, have = queue.pop()
        for t in sorted(rows):
            both = have & rows[t]
            if (not own or t > own[-1]) and both.bit_count() >= support * n and (both & wrong).bit_count() >= support * confidence * n:
                share = (both & wrong).bit_count() / both.bit_count()
                if share < 1:  # a rule without exception implies all longer ones
                    queue.append(((*own, t), both))
                if share >= confidence:
                    found[frozenset((*own, t))] = share
    return {x: c for x, c in found.items() if not any(y < x and found[y] >= c for y in found)}


def test_rules_of_long_urls_are_complete(spark):
    rng = random.Random(8)
    pages, labels = [], []
    for i in range(240):
        spam = i < 80
        path = ["always"] + (["zeta", "omega"] if spam or i % 10 == 0 else [])
        path += [f"strong{k}" for k in range(8)] if spam and i % 2 else [f"calm{k}" for k in range(11)] if not spam and i % 2 else []
        path += [f"free{k}" for k in range(6) if rng.random() < (0.7 if spam else 0.4)] + [f"once{i}-{k}" for k in range(4)]
        pages.append((i, "http://h.org/" + "/".join(path)))
        labels.append((i, 1 if i % 5 else None, int(spam)))
    p, q = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sets = {r["page_id"]: set(r["t"]) for r in rows_of(p.select("page_id", url_rules.url_tokens(F.col("url")).alias("t")))}
    assert max(map(len, sets.values())) >= 20
    want = plain_rules([sets[i] for i in range(240)], range(80), 0.1, 0.6)
    rules = rows_of(url_rules.mine(p, q, support=0.1, confidence=0.6))
    got = {frozenset(x): r["confidence"] for r in rules for x in itertools.product(*r["members"])}
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)
    assert any(len(x) > 1 for x in want) and frozenset({"p:omega"}) in want
    new = [(1000, "http://x.com/omega"), (1001, "http://x.com/strong7"), (1002, "http://x.com/calm3/always"), (1003, "http://h.org/free1/free2/free5/free0")]
    new = spark.createDataFrame(new, "page_id long, url string")
    own = {r["page_id"]: set(r["t"]) for r in rows_of(new.select("page_id", url_rules.url_tokens(F.col("url")).alias("t")))}
    for r in rows_of(url_rules.match(new, url_rules.mine(p, q, support=0.1, confidence=0.6)).join(new, "url")):
        tokens = own.pop(r["page_id"])
        assert any(x <= tokens for x in want)
    assert not any(x <= t for x in want for t in own.values())


# -- op4 ----------------------------------------------------------------------

TEXTS = [
    None, "", " \n\t", "word", "a b c d e f g h i j", "a b c d e a b c d e x y z", "x " * 40, "a a a a a a a\na a a a a a a\n\na a a", "one\ntwo\none\n\r\ntwo\none",
    "é ü # $ | < >\u00a0b \x0b c\x0cd", "😀 emoji 😀😀 words here and there again once more now", "the same line of words again\n" * 5, "\n\n\n", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 " * 3,
]


def test_base_counts(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["a ", "b ", "c\n", "d\t", "#", "ü "]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, None, None, "clash") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in rows_of(outliers.text_statistics(docs))}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.base_counts(t), repr(t)


def test_outliers_are_rejected_per_group(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    rows = []
    for i in range(400):
        text = " ".join(word() for _ in range(60))
        rows.append((i, text if i % 10 else text.replace(" ", "### ").upper(), "en" if i % 2 else None, f"s{i % 4 // 2}", ""))
    got = rows_of(outliers.judge(spark.createDataFrame(rows, DOCS)))
    assert len(got) == 400
    assert {r["doc_id"] for r in got if not r["kept"]} == set(range(0, 400, 10))


def test_small_and_empty_groups_are_kept(spark):
    rows = [(i, f"some words that are all here number {i} in a short text", "en", "s", "") for i in range(5)]
    got = rows_of(outliers.judge(spark.createDataFrame(rows + [(9, None, None, None, None)], DOCS)))
    assert {r["doc_id"]: r["kept"] for r in got} == {i: True for i in range(5)} | {9: False} and all(r["distance"] is None for r in got)
    assert rows_of(outliers.judge(spark.createDataFrame([], DOCS))) == []


def test_chi_square():
    assert outliers.chi2_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3) and outliers.chi2_below(7.8147, 4) == pytest.approx(0.9014, abs=1e-3)


# -- op7 ----------------------------------------------------------------------


def test_contamination(spark):
    rng = random.Random(4)
    sentence = lambda n: " ".join(rng.choice("alpha Beta gamma delta 7 ÉCLAIR zeta".split()) for _ in range(n))
    items = {1: sentence(14), 2: sentence(10), 3: "single", 4: "two words", 5: "", 6: None, 7: sentence(30), 10: "Two, words"}
    docs = {i: sentence(rng.randint(0, 40)) for i in range(60)}
    docs |= {100: items[1], 101: f"x, {items[7]}! {items[7]} y", 102: None, 103: "", 104: "...", 105: "a single one", 106: "TWO-WORDS two words", 107: " ".join(items[2].split()[:9])}
    d = spark.createDataFrame([(i, t, None, None, "clash") for i, t in docs.items()] + [(100, items[1], None, None, None), (None, items[2], None, None, None), (100, "other", None, None, None)], DOCS)
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows_of(decontaminate.contamination(d, b))]
    want = [(i, *x) for i, x in brute.contamination(docs, items).items()]
    again = brute.contamination({0: items[1], 1: items[2], 2: "other"}, items)
    want += [(100, *again[0]), (None, *again[1]), (100, *again[2])]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_contamination_of_empty_tables(spark):
    none, docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b", None, None, "")], DOCS)
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in rows_of(decontaminate.contamination(docs, none))] == [(2, 0, [])]
    assert rows_of(decontaminate.contamination(docs.limit(0), none)) == []


def test_op7_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    want = brute.contamination(docs, items)
    for r in rows_of(queries.QUERIES["op7_benchmark_decontamination"](spark, FOLDER)):
        words, hit, named = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (words, hit, len(named), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()


# -- op9 ----------------------------------------------------------------------


def test_shards_follow_weights_and_growth(spark):
    base = [shards.Leaf(s, f"r{s // 4}", f"k{s // 2}", 1.0 + s % 2) for s in range(8)] + [shards.Leaf(99, "r0", "k0", 0.0)]
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    more = {"now": [], "new": [shards.Leaf(8, "r1", "k3", 2.0)], "both": [shards.Leaf(8, "r1", "k3", 2.0), shards.Leaf(3, "r0", "k1", 1.0)]}
    rows = shards.place(df, "doc_id", base, more).collect()
    share = Counter(r.now for r in rows)
    assert set(share) == set(range(8)) and all(abs(share[s] / 20000 - (1 + s % 2) / 12) < 0.012 for s in range(8))
    assert all(r.now == r.new or r.new == 8 for r in rows) and all(r.new == r.both or r.both == 3 for r in rows)
    assert abs(sum(r.new == 8 for r in rows) / 20000 - 2 / 14) < 0.012


def test_slots_have_no_gaps(spark):
    rows = [(i % 50 if i % 3 else None, i, "x", "y") for i in range(3000)] + [(7, 1, "x", "y")] * 500
    df = spark.createDataFrame(rows, "doc_id long, size long, slot string, part string").repartition(7)
    tree = shards.Tree.even(40)
    got = shards.assign(df, "doc_id", tree, tree.grown(shards.Leaf(40, "region0", "rack0")), ["doc_id", "size"]).collect()
    assert len(got) == 3500 and {"part", "doc_id", "size", "shard", "slot", "grown_shard"} == set(got[0].asDict())
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert shards.assign(df.limit(0), "doc_id", tree, tree, ["doc_id"]).count() == 0


def test_op9_query_and_written_shards(spark, tmp_path):
    got = queries.QUERIES["op9_sharding"](spark, FOLDER).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t) + 16, brute.crc(t)) for i, t in docs.items()}
    assert {r.shard for r in got} <= set(range(40)) and all(r.grown_shard in (r.shard, 40) and r.law == "key" for r in got)
    shards.write_shards(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id", shards.Tree.even(40), str(tmp_path / "out"))
    back = {r.doc_id: r.shard for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back == {r.doc_id: r.shard for r in got}
