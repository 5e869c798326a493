"""Phrases against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from stockloom.llm import phrases


def plain(docs, least, longest, top):
    counts = {}
    for lang, text in docs:
        c = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            c.update(tuple(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        often = {g: v for g, v in c.items() if len(g) > 1 and v >= least}
        gone = {g[i:i + k] for g, v in often.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if c[g[i:i + k]] <= v}
        rows = []
        for g, a in often.items():
            if g not in gone:
                score, _, left, right = min((1000 * a * n // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def found(spark, docs, *args):
    rows = spark.createDataFrame([(lang, text, 1) for lang, text in docs], "lang string, text string, n long").repartition(5)
    return sorted(map(tuple, phrases.phrases(rows, *args).collect()))


def test_equals_plain_counting(spark):
    rnd = random.Random(3)
    common = ["new york city hall", "New York", "in the end of the day", "a b a b a b a", "Ünï côde wörd", "x\x0by\tz"]
    docs = [(rnd.choice(["en", "de", None, "und"]), " ".join(rnd.choice([*common, *"abcde", "w%d" % rnd.randrange(30), "stop.", "go, on", "!?"]) for _ in range(rnd.randrange(40)))) for _ in range(300)]
    docs += [(None, None), ("en", ""), ("en", " \t .,"), ("fr", "only once"), *[("es", "same text here again")] * 50, ("de", "la " * 20_000)]
    for least, top in ((10, 2000), (1, 25)):
        assert found(spark, docs, least, 5, top) == plain(docs, least, 5, top)


def test_sparse_ids_and_long_words(spark):
    rnd = random.Random(4)
    words = [f"v{i}" for i in range(18_000)]
    rnd.shuffle(words)
    docs = [("en", " ".join(words[i:i + 600])) for i in range(0, 18_000, 600)] * 2 + [("en", "z" * 300 + " " + "y" * 70)] * 2
    got = found(spark, docs, 2, 3, 30_000)
    assert got == plain(docs, 2, 3, 30_000) and len(got) > phrases.ZONE


def test_tables_without_rows_or_words(spark):
    for docs in ([], [("en", None)], [("en", "once said")]):
        assert found(spark, docs, 2, 5, 10) == []


def test_packed_ids_and_codes():
    rnd = np.random.default_rng(0)
    for ids in (np.array([], np.int64), np.array([-1]), rnd.integers(-1, 1 << 40, 1000), rnd.integers(-1, 3, 77)):
        assert (phrases.unpack_ids(phrases.pack_ids(ids)) == ids).all()
    assert phrases.squeezed(np.array([-1, -1, 3, -1, -1, -1, 4, 5, -1])).tolist() == [-1, 3, -1, 4, 5, -1]
    a, b = np.array([1 << 40, 5, 1 << 40, 5]), np.array([1 << 41, 1, 1 << 41, 2])  # products beyond 63 bits
    code = phrases.codes(a, b)
    assert code[0] == code[2] and len(set(code.tolist())) == 3
    seq, words, n = phrases.cut(pa.array(["A b. a", None, "b"], pa.large_string()))
    assert [words[i].as_py() if i >= 0 else None for i in seq] == ["a", "b", None, "a", None, "b"] and n.tolist() == [2, 2]
