"""Token blocks, language ID, SimHash, suffix arrays, perplexity and n-best against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockloom.llm import components, language, nbest, perplexity, queries, simhash, suffixes, token_blocks

from . import brute

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, hash string"


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


# -- op2 ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t


def test_words_encode_as_the_tokenizer(tokenizer):
    rng = random.Random(1)
    words = token_blocks._words(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    coder = token_blocks.encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    texts = []
    signs = ["a", "The", "'s", " ", " ", "\n", ".", "ö", "1", "½", "\t", " ", "<|endoftext|>", "日", "\x00", "x\x1c", ", ", " "]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 9)))
        assert words.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        texts.append(text)
    for _low, found, ends in coder.encode(pa.array(texts)):  # what write_tokens runs
        for text, own in zip(texts[_low:], np.split(found, ends[:-1])):
            assert own.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4096, 4097, 9000):
        for top in (1, 2, 300, 50257, 1 << 20, (1 << 32) - 1):
            ids = rng.integers(0, top, n, dtype=np.uint32)
            ids[::97] = (1 << 32) - 1
            value = token_blocks.pack(ids)
            assert (token_blocks.unpack(value) == ids).all()
            a, b = sorted(rng.integers(0, n + 1, 2))
            assert (token_blocks.unpack(value, a, b) == ids[a:b]).all()
    few = np.full(4096, 7, np.uint32)
    few[5] = 1 << 31
    index = token_blocks.block_index(token_blocks.pack(few))
    assert index["width"].tolist() == [0] and index["exceptions"].tolist() == [1]


def test_token_files(spark, tokenizer, tmp_path, monkeypatch):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(300)] + [(5, None), (5, "other"), (5, "other"), (None, "no id"), (900, ""), (901, "long " * 40000)]
    docs = spark.createDataFrame([(i, t, None, "clash") for i, t in rows], DOCS).repartition(5)
    path = str(tmp_path / "tokens")
    token_blocks.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), path, end_id=0)
    back = sorted(token_blocks.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    want = Counter((i, *tokenizer.encode(t or "", add_special_tokens=False).ids, 0) for i, t in rows)
    assert Counter((r.doc_id, *r.ids) for r in back) == want
    assert [r.start for r in back] == [0, *np.cumsum([len(r.ids) for r in back])[:-1]]
    digests = {(r.start, r.n_tokens, r.ids_crc32) for r in token_blocks.token_digests(spark, path).collect()}
    assert digests == {(r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in back}


def test_op2_query(spark, tokenizer):
    start = 0
    got = {r.doc_id: r for r in queries.QUERIES["op2_token_blocks"](spark, FOLDER).collect()}
    for i, t in sorted(documents(spark).items()):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# -- op3 ----------------------------------------------------------------------


def plain_grams(text):
    t = " " + " ".join(text.lower().split()) + " "
    return {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_numbers_stand_for_the_set_of_ngrams(monkeypatch):
    s = language.Spectrum()
    for a, b in (("the cat sat", "the  CAT ran"), ("\0\U0010ffff", "\U0010ffff\0"), ("日本語 テキスト", "日本 語"), ("", "x")):
        assert len(s.grams(a)) == len(plain_grams(a)) and len(np.intersect1d(s.grams(a), s.grams(b))) == len(plain_grams(a) & plain_grams(b))
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(4000))
    whole = s.grams(long)
    monkeypatch.setattr(language, "SLICE", 1000)
    assert len(whole) == len(plain_grams(long)) and (s.grams(long) == whole).all()


def test_scores_equal_plain_kernel_ridge():
    rng = random.Random(11)
    words = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "the cat sat on a mat".split(), "cc": "日本 語の 文 章".split()}
    rows = [(lang, " ".join(rng.choices(words[lang] + ["x", "1"], k=rng.randint(2, 12)))) for lang in words for _ in range({"aa": 9, "bb": 20, "cc": 12}[lang])]
    rows = [(lang, text) for lang, text in rows if language.LETTER.search(text)]
    marks = [t for lang in words for t in [text for own, text in rows if own == lang][:5]]
    kernel = lambda a, b: len(plain_grams(a) & plain_grams(b)) / (len(plain_grams(a)) * len(plain_grams(b))) ** 0.5
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    k = np.array([unit([kernel(t, m) for m in marks]) for _, t in rows])
    size = [sum(own == lang for own, _ in rows) for lang, _ in rows]
    w = np.diag([len(rows) / (3 * n) for n in size])
    y = np.array([[1.0 if own == lang else -1.0 for lang in words] for own, _ in rows])
    between = np.array([[kernel(a, b) for b in marks] for a in marks])
    weights = np.linalg.inv(k.T @ w @ k + 0.01 * between + 1e-6 * len(rows) * np.eye(len(marks))) @ (k.T @ w @ y)
    model = language.fitted(rows, landmarks=5)
    asked = [t for _, t in rows] + ["lorem cat 語の", "zzz"]
    names, scores = model.predict(asked)
    for text, name, score in zip(asked, names, scores):
        v = unit([kernel(text, m) for m in marks]) @ weights
        share = np.exp(4 * v) / np.exp(4 * v).sum()
        assert abs(score - share.max()) < 1e-3 and share[list(words).index(name)] > share.max() - 1e-3


def test_very_long_texts_keep_their_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where(~language.held_out(docs)))
    for lang in model.languages:
        texts = [r.text for r in docs.where(language.held_out(docs) & (F.col("lang") == lang) & F.col("text").isNotNull()).select("text").collect()]
        joined = " ".join(texts)
        names, scores = model.predict([joined, " ".join([joined] * (5_000_000 // len(joined) + 1))])
        assert names == [lang] * 2 and min(scores) > 0.9


def test_a_repeated_row_and_no_shuffle_of_texts_by_language(spark):
    docs = spark.createDataFrame([(1, "uno dos", "es", "")] * 50 + [(2, "one two", "en", "")], DOCS)
    assert [t for t in language.sample(docs, 3)] == [("en", "one two")] + [("es", "uno dos")] * 3


def test_language_accuracy_and_edges(spark):
    got = queries.QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert sum(held) / len(held) > 0.97
    docs = spark.createDataFrame([(1, None, "en", ""), (2, "", "en", ""), (3, "12 !?", None, ""), (None, "the", None, ""), (3, "12 !?", None, "")], DOCS)
    assert [(r.lang_pred, r.score) for r in language.identified(docs.limit(3)).collect()] == [("und", 0.0)] * 3
    assert language.identified(docs).count() == 5 and language.identified(docs.limit(0)).count() == 0


def test_fit_does_not_read_held_out_rows(spark):
    rows = [(i, "uno dos tres" if i % 2 else "one two three", "es" if i % 2 else "en", "") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    swapped = docs.withColumn("lang", F.when(language.held_out(docs), "xx").otherwise(F.col("lang")))
    assert {r.lang_pred for r in language.identified(swapped).collect()} == {"en", "es"}


# -- op5 ----------------------------------------------------------------------


def test_coverings_hold_every_pair_within_the_radius():
    rng = random.Random(1)
    for bits, radius in ((list(range(64)), 4), (list(range(0, 64, 3)), 4), (list(range(32, 64)), 3), (list(range(64)), 1)):
        kept = simhash.masks(bits, radius)
        assert len(kept) == (1 << radius + 1) - 1 and all(kept)
        for _ in range(500):
            differ = sum(1 << b for b in rng.sample(bits, radius))
            assert any(not differ & m for m in kept)


def near_texts(rng, n):
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.choice([1, 3, 30, 200]))]
        out.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            v = list(w)
            v[rng.randrange(len(v))] = word()
            out.append(" ".join(v) if rng.random() < 0.7 else " ".join(w).upper())
    return out


def test_components_of_fingerprints(spark, monkeypatch):
    texts = near_texts(random.Random(7), 60) + [None, "", " \n", "Ünï cödé", "x " * 5000]
    docs = spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(texts)] + [(0, texts[0], None, "")], DOCS)
    want_prints = {i: brute.fingerprint(t) for i, t in enumerate(texts)}
    want = brute.components(want_prints)
    for split in (simhash.SPLIT, 64):  # the second sends every bucket through the split
        prints = simhash.with_fingerprints(docs.select("doc_id", "text"), 4)
        got = simhash.classes(prints, split=split).collect()
        assert len(got) == len(texts) + 1
        assert {r.doc_id: r.fingerprint & (1 << 64) - 1 for r in got} == want_prints
        assert {r.doc_id: r.component_id for r in got} == want


def test_large_buckets_are_searched_whole(monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 8)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    x = np.unique(np.array([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for c in np.repeat(centres, 60)], np.uint64))
    a, b = simhash.links(x[:, None], simhash.Slice(0, 0, 64), 4, 4)
    parent = list(range(len(x)))
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in zip(a.tolist(), b.tolist()):
        parent[max(root(i), root(j))] = min(root(i), root(j))
    want = brute.components(dict(enumerate(x.tolist())))
    assert [root(i) for i in range(len(x))] == [want[i] for i in range(len(x))]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (None, 7), (1001, 1002), (-3, -9)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)} | {-3: -9, -9: -9}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, origin = {}, {}
    for k in range(40):
        w = [word() for _ in range(400)]
        for c in range(3):
            v = list(w)
            for at in rng.sample(range(400), 4 if c else 0):
                v[at] = word()
            texts[3 * k + c], origin[3 * k + c] = " ".join(v), k
    rows = [(i, t, None, "h") for i, t in texts.items()] + [(0, texts[0], None, "h"), (500, None, None, ""), (501, None, None, ""), (None, "alone", None, "")]
    got = simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter(origin.get(r.doc_id) for r in got if r.doc_id in origin) == Counter(range(40))
    assert {r.doc_id for r in got if r.doc_id not in origin} == {500, 501, None} and set(got[0].asDict()) == {"doc_id", "text", "lang", "hash"}


# -- op6 ----------------------------------------------------------------------


def test_suffix_order_and_common_prefixes():
    rng = random.Random(2)
    for trial in range(60):
        regions = [bytes(rng.choice(b"ab\0" if trial % 2 else b"abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 12))]
        regions += regions[:2] * (trial % 3)
        s = suffixes.Shard(regions, 10)
        places = [(int(a), int(b)) for a, b in zip(s.starts, s.ends)]
        text = s.text.tobytes()
        rest = {p: text[p:e] for a, e in places for p in range(a, e)}
        assert [rest[p] for p in s.order.tolist()] == sorted(rest.values())
        order = s.order.tolist()
        for r in range(1, len(order)):
            if len(rest[order[r]]) >= 10:
                a, b = rest[order[r - 1]], rest[order[r]]
                n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                assert s.common[r] == min(n, 10)


def repeat_texts(rng):
    base = ["".join(rng.choice("abcdefgh é\n") for _ in range(rng.randint(0, 300))) for _ in range(25)]
    passage = "".join(rng.choice("xyz ") for _ in range(90))
    out = list(base)
    for t in base[:15]:
        cut = rng.randint(0, len(t))
        out += [t[:cut] + passage + t[cut:], t[:cut] + rng.choice("QRS") + t[cut:]]
    return out + ["a" * 500, "ab" * 130, "", passage[:40], passage[:39], base[0], base[0]]


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, monkeypatch, small):
    texts = repeat_texts(random.Random(3)) + [None]
    if small:
        monkeypatch.setattr(suffixes, "SHARD", 600)
        monkeypatch.setattr(suffixes, "GROUP", 700)
    docs = spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(texts)] + [(3, texts[3], None, "again")], DOCS)
    raw = [(t or "").encode() for t in texts] + [texts[3].encode()]
    covered = brute.repeated_bytes(raw, 40)
    got = suffixes.remove_repeats(docs, length=40, task=3 if small else suffixes.TASK).collect()
    assert len(got) == len(raw)
    for r in got:
        i = r.doc_id if r.hash != "again" else len(raw) - 1
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == brute.cut(raw[i], covered[i]), i
        left = bytes(b for b, c in zip(raw[i], covered[i]) if not c)
        assert r.kept == (None if r.text is None else left.decode("utf-8", "ignore"))


def test_whole_anchors_make_one_suffix_array(monkeypatch):
    """Where the last anchor reaches over the limit, its rest is no suffix array of its own, and nothing is signed."""
    rng = random.Random(4)
    regions = [rng.randbytes(60) for _ in range(12)]
    regions[11] = regions[10][:50] + regions[11][:10]
    anchor = [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4, 4]
    batch = pa.table({"anchor": anchor, "salt": [-1] * 12, "hash": list(range(12)), "size": [60] * 12, "start": [0] * 12, "twin": [False] * 12, "raw": pa.array(regions, pa.binary())}).to_batches()[0]
    monkeypatch.setattr(suffixes, "SHARD", 550)
    built, signed, real = [], [], suffixes.Shard
    sign = real.signatures
    monkeypatch.setattr(real, "signatures", lambda *a: signed.append(a) or sign(*a))
    monkeypatch.setattr(suffixes, "Shard", lambda *a: built.append(a) or real(*a))
    got = pa.Table.from_batches(suffixes._search(40)(iter([batch]))).to_pylist()
    assert len(built) == 1 and not signed
    assert sorted((r["hash"], r["start"], r["end"]) for r in got) == [(10, 0, 50), (11, 0, 50)]


def test_op6_query(spark):
    docs = sorted(documents(spark).items())
    raw = [(t or "").encode() for _, t in docs]
    covered = brute.repeated_bytes(raw)
    got = {r.doc_id: r for r in queries.QUERIES["op6_suffix_array_dedup"](spark, FOLDER).collect()}
    for (i, _), b, c in zip(docs, raw, covered):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == brute.cut(b, c)


# -- op8 ----------------------------------------------------------------------


def plain_model(texts, order):
    """log p of a character after its context, by the textbook recursion."""
    grams = Counter()
    for t in texts:
        padded = perplexity.PAD * (order - 1) + t
        grams.update(padded[i:i + order] for i in range(len(t)))
    counts = {order: grams}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, contexts = {}, {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discount[n] = [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        contexts[n] = defaultdict(list)
        for g, v in c.items():
            contexts[n][g[:-1]].append(v)

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        below, seen = p(gram[1:]), contexts[n].get(gram[:-1])
        if not seen:
            return below
        off = sum(discount[n][min(v, 3) - 1] for v in seen) / sum(seen)
        v = counts[n].get(gram, 0)
        return (v - discount[n][min(v, 3) - 1] if v else 0) / sum(seen) + off * below

    return p, len(counts[1])


@pytest.mark.parametrize("shard", [perplexity.SHARD, 40])
def test_kneser_ney(spark, shard):
    rng = random.Random(4)
    line = lambda n: "".join(rng.choice(["the ", "cat ", "sat. ", "é", "on ", "\n"]) for _ in range(n))
    train, test = [line(30) for _ in range(20)], [line(12), "zzz the", "", None, "😀", line(3)]
    model = perplexity.train(spark.createDataFrame([(t,) for t in [*train, "", None]], "text string"), 3)
    p, kinds = plain_model(train, 3)
    floor = plain_model(train, 3)[0]
    unseen = math.log(1 / (kinds + 1.0) ** 2)
    docs = spark.createDataFrame(list(enumerate(test)), "doc_id long, text string")
    got = {r.doc_id: r for r in perplexity.log_probability(docs, model, 3, unseen, shard).collect()}
    known = {c for t in train for c in t}
    for i, t in enumerate(test):
        padded, want = perplexity.PAD * 2 + (t or ""), 0.0
        for k in range(len(t or "")):
            gram = padded[k:k + 3]
            if gram[-1] in known:
                want += math.log(floor(gram))
            else:
                want += unseen + sum(math.log(_backoff(train, gram[3 - n:2], n)) for n in (2, 3) if _backoff(train, gram[3 - n:2], n))
        assert got[i].logp == pytest.approx(want, rel=1e-4, abs=1e-4), repr(t)
        assert got[i].n_chars == len(t or "")


def _backoff(train, context, n):
    """Backoff weight of ``context`` at order n of a model of order 3; 0 if it was not seen."""
    grams = Counter()
    for t in train:
        padded = perplexity.PAD * 2 + t
        grams.update(padded[i:i + 3] for i in range(len(t)))
    if n == 2:
        grams = Counter(g[1:] for g in grams)
    n1, n2, n3, n4 = (max(1, sum(v == k for v in grams.values())) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    seen = [v for g, v in grams.items() if g[:-1] == context]
    return sum(d[min(v, 3) - 1] for v in seen) / sum(seen) if seen else 0


def test_gram_table_finds_all_and_nothing_else():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(1, 1 << 63, 5000, dtype=np.uint64))
    table = perplexity.GramTable(keys, np.arange(len(keys)) + 1.0, np.zeros(len(keys)))
    assert (table.find(keys)[:, 0] == np.arange(len(keys)) + 1).all()
    assert not table.find(rng.integers(1, 1 << 63, 5000, dtype=np.uint64)).any()


def test_quality_edges(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice("this is a calm and plain text of words".split()) for _ in range(40))
    rows = [(i, good(), "en" if i % 2 else None, "") for i in range(200)] + [(900, "#$% @@ ^&* " * 20, "en", ""), (901, "", "en", ""), (902, None, None, ""), (903, good(), "xx", ""), (903, good(), "xx", ""), (None, good(), "en", "")]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1, None) for i in range(200)] + [(900, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = perplexity.judge(docs, labels).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if not r.kept} <= {900} | set(range(200)) and not next(r.kept for r in got if r.doc_id == 900)
    assert sum(not r.kept for r in got) <= 3
    assert all(r.kept and r.perplexity is None for r in perplexity.judge(docs, labels.limit(0)).collect())
    assert perplexity.judge(docs.limit(0), labels).count() == 0


# -- op10 ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return nbest.Pieces.read(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())


def all_ways(m, text):
    out = []

    def go(i, score, ids):
        if i == len(text):
            out.append((score, tuple(ids)))
            return
        single = False
        for j in range(i + 1, len(text) + 1):
            if (piece := text[i:j]) in m.scores:
                single |= j == i + 1
                go(j, score + m.scores[piece], [*ids, m.ids[piece]])
        if not single:
            go(i + 1, score + m.unknown, ids + [m.byte_ids[b] for b in text[i].replace(nbest.LITERAL, nbest.SPACE).encode()])

    go(0, 0.0, [])
    return sorted(out, reverse=True)


def test_nbest_is_the_best_of_all_ways(pieces):
    rng, table = random.Random(6), nbest.Table(pieces)
    for _ in range(400):
        text = "".join(rng.choice(["th", "er", "a", " ", nbest.SPACE, ".", "ö", "\n", "x1", "日", "²"]) for _ in range(rng.randint(0, 6)))
        want, got = all_ways(pieces, nbest.marked(text)), pieces.encode(text, 5)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:5]], abs=1e-3), repr(text)
        assert len({ids for _, ids in got}) == len(got) and {ids for _, ids in got} <= {ids for _, ids in want}
        assert all(pieces.decode(ids) == text for _, ids in got)
        ids, score, following = table.encode(text)
        assert score == pytest.approx(got[0][0], abs=1e-3) and table.decoded(ids) == text.encode()
        assert following == pytest.approx(got[1][0], abs=1e-3) if len(got) > 1 else following == -math.inf


def test_segment_edges(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, None, None, "c"), (2, "", None, "c"), (3, " a  b ", None, "c"), (4, "x" * 30000, None, "c"), (None, "y\ty", None, "c"), (3, " a  b ", None, "c")]
    docs = spark.createDataFrame(rows, DOCS)
    for n in (1, 2, 3):
        got = nbest.segment(docs, path, n).collect()
        assert [r.decoded for r in got] == [t for _, t, _, _ in rows] and set(got[0].asDict()) == {"doc_id", "text", "lang", "hash", "ids", "score", "next_score", "decoded"}
        assert got[0].ids is None and got[1].ids == [] and got[1].score == 0
    digest = nbest.digest(docs, path).collect()
    full = nbest.segment(docs, path, 2).collect()
    assert [(r.n_pieces, r.ids_crc32, r.exact) for r in digest] == [(len(r.ids or []), zlib.crc32(np.array(r.ids or [], "<i4").tobytes()), True) for r in full]
    assert nbest.segment(docs.limit(0), path).count() == 0
