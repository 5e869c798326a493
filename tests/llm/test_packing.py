"""Packing: the plan on histograms, and all pieces against plain encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stockloom.llm import packing, words

FILE = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(counts, capacity):
    """Sequences that best-fit decreasing takes."""
    room = {}
    n = 0
    for s in sorted(counts, reverse=True):
        for _ in range(counts[s]):
            r = min((x for x, k in room.items() if x >= s and k), default=None)
            if r is None:
                n, r = n + 1, capacity
            else:
                room[r] -= 1
            room[r - s] = room.get(r - s, 0) + 1
    return n


@pytest.mark.parametrize("name", ["uniform", "large", "few", "none", "full", "copies", "halves"])
def test_plan_holds_all_and_is_no_worse_than_best_fit(name):
    rng = np.random.default_rng(1)
    counts = {"uniform": {s: int(rng.integers(1, 12)) for s in range(1, 1025, 3)}, "large": {s: int(rng.integers(1, 20)) for s in range(300, 1024, 5)}, "few": {3: 1, 1000: 1},
              "none": {}, "full": {1024: 7}, "copies": {400: 3000, 700: 200, 90: 20_000, 1024: 3}, "halves": {512: 11, 513: 4, 511: 4}}[name]
    got, n = {}, 0
    for configuration, times in packing.plan(counts, 1024):
        assert times > 0 and sum(s * k for s, k in configuration) <= 1024
        n += times
        for s, k in configuration:
            got[s] = got.get(s, 0) + k * times
    assert got == counts and n <= best_fit(counts, 1024)
    assert n >= max(-(-sum(s * k for s, k in counts.items()) // 1024), sum(k for s, k in counts.items() if s > 512))


def test_best_configuration_and_fullest():
    sizes = np.array([3, 5, 7])
    assert packing.best_configuration(sizes, np.array([3.0, 5.5, 7.0]), 10).tolist() == [0, 2, 0]
    assert packing.fullest(sizes, np.array([9, 9, 1]), 17).tolist() == [0, 2, 1]
    assert packing.fullest(sizes, np.array([0, 0, 0]), 17).tolist() == [0, 0, 0]


TEXTS = ["", None, "one", " two  words \n\n and\ttabs ", "a <|endoftext|> b", "über weit leer 日本語 テスト　x", "it's we'll \n next", "w " * 3000, "x" * 5000, " ", "\n", "tail ", "’quoted’ \U0001f600 ok"]


def test_ids_equal_plain_encoding():
    plain = Tokenizer.from_file(FILE)
    own = words.Encoder(open(FILE, encoding="utf-8").read())
    for texts in (TEXTS, TEXTS[::-1], [], [None, ""], ["plain words only", "more words"]):
        for low, ids, ends in own.encode(pa.array(texts, pa.string())):
            for t, x in zip(texts[low:], np.split(ids, ends[:-1]) if len(ends) else []):
                assert x.tolist() == plain.encode(t or "", add_special_tokens=False).ids
    kept = words.KEPT
    try:  # forgotten words are encoded again
        words.KEPT = 1
        for _, ids, ends in own.encode(pa.array(["some words", "more words"], pa.string())):
            assert ids.tolist() == plain.encode("some words").ids + plain.encode("more words").ids
    finally:
        words.KEPT = kept


def test_pieces_against_plain_encoding(spark):
    texts = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "repeated id"), (3, "repeated id")] + [(100 + i, "word " * (i * 37 % 900)) for i in range(120)] + [(900, "many copies")] * 300
    docs = spark.createDataFrame([(*r, 1) for r in texts], "doc_id long, text string, offset long").repartition(7)
    rows = packing.pack(docs, FILE, 256, 2, keep_ids=True).collect()
    plain = Tokenizer.from_file(FILE)
    want = []
    for i, t in texts:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        n = -(-len(ids) // 256)
        cuts = [0, *range(len(ids) - 256 * (n - 1), len(ids) + 1, 256)]
        want += [(i, k, x, y - x, zlib.crc32(np.array(ids[x:y], "<u4").tobytes()), tuple(ids[x:y])) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids))) for r in rows)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert set(filled) == set(range(len(filled))) and max(filled.values()) <= 256
    counts = {}
    for r in rows:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len(filled) <= best_fit(counts, 256)


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0


def test_words_are_cut_at_signs_and_ids_stay():
    coder = words.Encoder(open(FILE, encoding="utf-8").read())
    encoded = lambda texts: [p.tolist() for _, ids, ends in coder.encode(pa.array(texts)) for p in np.split(ids, ends[:-1])]
    texts = [" ".join(f"w{chr(97 + i)}rd{sign}" for i in range(20)) for sign in ",.;!"]
    assert encoded(texts) == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder.n < 80  # with its sign, each word would be another one
    rnd = random.Random(4)
    letters = ["a", "Z", "s", "t", "re", "ll", "'", "9", ".", ",", "é", "—", "日", " ", "_", "\x00", "\n", "$", "²", "٣", "x"]
    texts = ["".join(rnd.choices(letters, k=30)) for _ in range(2000)] + ["it's 3.5%, don't'sve", "1,000.50$ a--b", "x<|endoftext|>.y", ""]
    assert encoded(texts) == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
