"""All n segmentations, by the search over the lattice."""

import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from stockloom.llm import common, nbest

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts(k):
    rng = random.Random(8)
    return ["".join(rng.choice(["the", "er", "a", " ", "  ", ".", "ö", "\n", "x1", "日", " winter"]) for _ in range(rng.randint(0, 30))) for _ in range(k)]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_table_gives_the_n_best_ways(n, monkeypatch):
    pieces = nbest.Pieces.read(open(PATH, "rb").read())
    searched, search = [], nbest.Lattice.search
    monkeypatch.setattr(nbest.Lattice, "search", lambda self, words, n: searched.extend(words) or search(self, words, n))
    monkeypatch.setattr(nbest, "LONGEST", 40)
    table = nbest.Table(pieces, n)
    every = [*texts(150), "ab" * 50 + "日" * 60 + " x", "   ", nbest.SPACE, "a" + nbest.SPACE + " b", ""]
    together = [ways for _, run in table.runs(pa.array(every)) for ways in run]
    assert len(searched) == len(set(searched))
    for text, got in zip(every, together):
        alone = table.encode_ways(text)
        assert [(s, ids.tolist()) for s, ids in alone] == [(s, ids.tolist()) for s, ids in got]
        want = nbest.best_of([pieces.search(c, n) for c in nbest.CHUNKS.findall(nbest.marked(text))], n) if text else [(0.0, ())]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=1e-3), repr(text)
        assert len({tuple(ids.tolist()) for _, ids in got}) == len(got)
        for score, ids in got:
            assert pieces.decode(ids.tolist()) == text
    assert len(searched) == len(set(searched))


def test_kept_chunks_are_bounded_and_forgotten(monkeypatch):
    pieces = nbest.Pieces.read(open(PATH, "rb").read())
    want = [nbest.Table(pieces, 2).encode_ways(t)[0][1].tolist() for t in texts(40)]
    monkeypatch.setattr(nbest, "KEPT", 1)
    monkeypatch.setattr(nbest, "RUN", 50)
    table = nbest.Table(pieces, 2)
    found = [ways for _, run in table.runs(pa.array([None, *texts(40)])) for ways in run]
    assert found[0] is None and [ways[0][1].tolist() for ways in found[1:]] == want
    model = open(PATH, "rb").read()
    with nbest._task_table(model, 2) as table:
        table.encode_ways("the winter")
        assert table.known
    assert not table.known and not table.used


def test_batches_are_searched_in_small_runs():
    pieces = nbest.Pieces.read(open(PATH, "rb").read())
    batch = pa.array(["the winter was cold " * 5000] * 30)
    sizes = [len(run) for _, run in nbest.Table(pieces, 2).runs(batch)]
    assert sum(sizes) == 30 and max(sizes) * 100_000 <= 1 << 20


def test_workers_give_back_what_they_keep_unused():
    """Freed blocks below one that is still used stay with the C library, unless it is told to return them."""
    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10

    @common.released
    def run(batches):
        blocks = [np.ones(6000) for _ in range(4000)]
        last.append(blocks[-1])
        yield from batches

    last: list = []
    steps = run(iter([1]))
    next(steps)
    before = held()
    assert list(steps) == [] and held() < before - 100


def test_queries_return_all_ways(spark):
    rows = list(enumerate([*texts(20), None, "", "the winter"]))
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    full = {r.doc_id: r for r in nbest.segment(docs, PATH, 3, all_ways=True).collect()}
    sums = {r.doc_id: r for r in nbest.digest(docs, PATH, 3).collect()}
    for i, text in rows:
        ways = full[i].ways
        if text is None:
            assert ways is None and sums[i].ways_crc32 == []
            continue
        assert ways[0].ids == full[i].ids and ways[0].score == full[i].score
        assert full[i].next_score == (ways[2].score if len(ways) == 3 else None)
        assert sums[i].ways_crc32 == [zlib.crc32(np.array(w.ids, "<i4").tobytes()) for w in ways]
    assert len(full[rows[-1][0]].ways) == 3
