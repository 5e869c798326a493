"""The pipeline against plain versions of its stages, each on what the stage before kept."""

import numpy as np
import public_tokenizers

import corpus_pipeline
from stockloom.llm import nbest, simhash

from . import brute, test_similar

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "repeats", "decontamination", "encoding"]


def test_covering_of_a_similarity():
    cover = simhash.Covering.of_similarity(0.8)
    assert cover.radius == 19 and cover.per_slice == 4 and cover.accept == 25


def test_every_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34 !", None, None, 7), (9003, "", "en", "s", 0), (9004, "the " + items[min(items)], "en", "s", 1), (None, "words without an id " * 5, None, None, 1)], docs.schema)
    docs = docs.union(extra)
    steps = dict(corpus_pipeline.STAGES)
    now = lambda df: {r.doc_id: r for r in df.collect()}

    kept = steps["language"](spark, docs, FOLDER)
    assert kept.columns == COLUMNS
    before, after = now(docs), now(kept)
    assert {9001, 9002, 9003} <= set(before) - set(after) and None in after
    assert all(after[i] == before[i] for i in after)

    docs, before = kept.where("doc_id is not null"), after
    kept = steps["near duplicates"](spark, docs, FOLDER)
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == test_similar.plain({i: r.text for i, r in before.items() if i is not None}, 5, (4, 5))

    docs, before = kept, now(kept)
    kept = steps["repeats"](spark, docs, FOLDER)
    after = now(kept)
    raw = [(r.text or "").encode() for r in before.values()]
    for (i, r), b, c in zip(before.items(), raw, brute.repeated_bytes(raw)):
        text = bytes(x for x, gone in zip(b, c) if not gone).decode("utf-8", "ignore")
        assert (after[i].text, after[i].n_chars, after[i].lang, after[i].source) == (text, len(text), r.lang, r.source)
    assert kept.columns == COLUMNS and len(after) == len(before)

    docs, before = kept, after
    kept = steps["decontamination"](spark, docs, FOLDER)
    hit = {i for i, x in brute.contamination({i: r.text for i, r in before.items()}, items).items() if x[1]}
    after = now(kept)
    assert kept.columns == COLUMNS and set(after) == set(before) - hit and 9004 not in after

    pieces = nbest.Pieces.read(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    last = now(steps["encoding"](spark, kept, FOLDER))
    assert set(last) == set(after)
    for i, r in last.items():
        assert r.exact and pieces.decode(r.ids) == after[i].text and r.n_pieces == len(r.ids)
        assert tuple(r.ids) == pieces.encode(after[i].text, 1)[0][1] or np.isclose(r.score, pieces.encode(after[i].text, 1)[0][0])


def test_whole_run_and_empty_documents(spark, tmp_path):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.where("exact").count() == got.count() > 100
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES[:-1]:
        empty = step(spark, empty, FOLDER)
        assert empty.columns == COLUMNS and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, FOLDER).count() == 0
