"""Near copies against Jaccard similarities of all pairs."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa

import corpus_pipeline
from stockloom.llm import simhash, similar


def plain(texts, length, least):
    """doc_ids that stay, by all pairs; ``least`` is (numerator, denominator)."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        if w:
            sets[i] = {tuple(w[k:k + length]) for k in range(max(1, len(w) - length + 1))}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both * least[1] >= least[0] * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i for i in texts if i not in sets or root(i) == i}


def edited(rnd, words, n):
    words = list(words)
    for i in rnd.sample(range(len(words)), n):
        words[i] = f"x{rnd.randrange(10**9)}"
    return " ".join(words)


def test_one_of_each_equals_all_pairs(spark):
    rnd = random.Random(5)
    texts, new = {}, lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    put = lambda t: texts.__setitem__(len(texts), t)
    for _ in range(60):  # pairs on both sides of the threshold
        base = new(rnd.choice([12, 60, 150, 400]))
        put(" ".join(base))
        put(edited(rnd, base, rnd.randrange(max(2, len(base) // 20))))
    template = new(200)  # texts of one template, similar by less than 0.8
    for _ in range(40):
        put(" ".join(template[:100] + new(27) + template[100:]))
    base = new(300)  # a family of edited copies
    for _ in range(40):
        put(edited(rnd, base, 4))
    texts |= {1000: "", 1001: None, 1002: " \n", 1003: "one two", 1004: "One  two", 1005: "one two three"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = [r.doc_id for r in similar.one_of_each(docs, 5, 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(texts, 5, (4, 5))
    assert len(set(range(120, 160)) & set(got)) == 40  # templates are no copies


def test_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(13)]  # 9 shingles
    texts = {0: " ".join(words), 1: " ".join(words[:12]), 2: " ".join(words[5:]), 3: " ".join([*words[1:], "y"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    assert {r.doc_id for r in similar.one_of_each(docs, 5, 0.8).collect()} == plain(texts, 5, (4, 5)) == {0, 2}


def test_stage_links_by_fingerprints_first(spark, monkeypatch):
    rnd, near, tried = random.Random(8), simhash.near_links, []
    base = [f"w{rnd.randrange(5000)}" for _ in range(400)]
    texts = {0: " ".join(base), 1: edited(rnd, base, 1), 2: "other words " * 3, 3: edited(rnd, base, 6), 4: None}

    def spied(nodes, *rest):
        tried.append(({r.f0 for r in nodes.collect()}, out := near(nodes, *rest), out.collect()))
        return out

    monkeypatch.setattr(simhash, "near_links", spied)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert got == plain(texts, 5, (4, 5)) == {0, 2, 4}
    (prints, _, pairs), = tried
    assert prints == {simhash.fingerprint(t.encode(), 5)[0] for t in texts.values() if t} and pairs


def test_sketches_keep_similar_pairs_and_drop_templates():
    rnd = random.Random(3)
    sets = lambda common, own: [np.array([rnd.getrandbits(63) for _ in range(n)], np.int64) for n in (common, own, own)]
    for common, own, similar_sets in [(800, 100, True), (80, 10, True), (8, 1, True), (8000, 1000, True), (300, 100, False), (500, 0, True)]:
        both, a, b = sets(common, own)
        x, y = np.concatenate([both, a]), np.concatenate([both, b])
        columns = {"a": [1], "b": [2], "size_a": [len(x)], "size_b": [len(y)], "bits_a": [similar._sketch(x)], "bits_b": [similar._sketch(y)]}
        out = list(similar._possible(Fraction(4, 5))([pa.RecordBatch.from_pydict(columns)]))
        assert sum(o.num_rows for o in out) == similar_sets
