"""Language identification with string kernels.

The kernel of two texts is the blended spectrum of their character n-grams by
presence: the number of n-grams (n = 1 to ``longest``, at most 3) that both have, over the
root of the product of the numbers each has. Three code points fit in 64 bits, so
n-grams are told apart exactly, however long a text is. Landmark texts, the same
number for each language, give the Nyström features: a text is described by its
kernels with the landmarks, brought to unit length, so that n-grams which no landmark
has (a long text has many) do not lower its score. On them a one-versus-rest kernel
ridge regression is solved in closed form. A batch of documents is scored by two matrix
products: presence by landmarks, features by weights.

Only the fit is bounded: ``per_language`` texts of each language, those with the least
hash of id and text, reach the driver. Every document is scored by its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import free_name, stage

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


#: Characters whose n-grams are sorted at once, rows of one matrix product, and languages whose counts are broadcast.
SLICE, ROWS, BROADCAST_LANGUAGES = 1 << 20, 256, 10_000


@dataclass(frozen=True)
class Spectrum:
    longest: int = 3

    def __post_init__(self):
        if not 1 <= self.longest <= 3:
            raise ValueError("n-grams are of 1 to 3 characters")

    def grams(self, text: str) -> np.ndarray:
        """Each different n-gram of ``text``, in lower case and with single spaces around words, as a number; ascending."""
        spaced = " " + " ".join(text.lower().split()) + " "
        out = np.empty(0, np.uint64)
        for at in range(0, len(spaced), SLICE):
            c = np.frombuffer(spaced[at:at + SLICE + self.longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
            parts, h = [], np.zeros(len(c), np.uint64)
            for n in range(1, self.longest + 1):
                if len(c) < n:
                    break
                h = (h[: len(c) - n + 1] << np.uint64(21)) | c[n - 1:]
                parts.append(h)
            own = np.unique(np.concatenate(parts))
            out = np.union1d(out, own) if len(out) else own
        return out


@dataclass(frozen=True)
class Model:
    spectrum: Spectrum
    languages: tuple[str, ...]
    grams: np.ndarray  # n-grams that some landmark has, ascending
    landmarks: np.ndarray  # presence of each in each landmark, over the landmark's root of n-grams
    weights: np.ndarray  # landmarks by languages

    def features(self, texts: list[str]) -> np.ndarray:
        """Kernels of texts with the landmarks, each text's of unit length (zero if it shares no n-gram)."""
        seen = np.zeros((len(texts), len(self.grams)), np.float32)
        for row, text in zip(seen, texts):
            own = self.spectrum.grams(text)
            at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
            row[at[self.grams[at] == own]] = 1
        k = (seen @ self.landmarks.T).astype(np.float64)
        return k / np.maximum(np.linalg.norm(k, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 where there is no letter or no language was learned.

        The score is the share of the best language in a softmax of the regression values.
        """
        known = [bool(t) and bool(LETTER.search(t)) and bool(self.languages) for t in texts]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, k in enumerate(known) if k]
        for at in range(0, len(rows), ROWS):
            part = rows[at:at + ROWS]
            values = self.features([texts[i] for i in part]) @ self.weights
            share = np.exp(4 * (values - values.max(1, keepdims=True)))
            share /= share.sum(1, keepdims=True)
            for i, best, p in zip(part, values.argmax(1), share.max(1)):
                names[i], scores[i] = self.languages[best], float(p)
        return names, scores


def sample(labelled: DataFrame, per_language: int) -> list[tuple[str, str]]:
    """Up to ``per_language`` (lang, text) of each language, by least hash.

    Rows are first thinned by hash in proportion to their language's count. The
    counts are broadcast if there are at most BROADCAST_LANGUAGES, so texts are not shuffled by language.
    """
    rows = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).where("lang is not null and text is not null")
    sizes = stage(rows.groupBy("lang").agg(F.count("*").alias("n")))
    share = (F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("n")
    near = rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGUAGES else sizes, "lang").where(share <= 4 * per_language + 40)
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= per_language)
    return [(r.lang, r.text) for r in first.orderBy("lang", "k").collect()]


def fitted(rows: list[tuple[str, str]], landmarks: int = 32, ridge: float = 1e-2, spectrum: Spectrum = Spectrum()) -> Model:
    """Model from (lang, text); the first ``landmarks`` texts of each language are its landmarks."""
    rows = [(lang, text) for lang, text in rows if LETTER.search(text)]
    languages = tuple(sorted({lang for lang, _ in rows}))
    if not languages:
        return Model(spectrum, (), np.empty(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    own = np.array([languages.index(lang) for lang, _ in rows])
    chosen = np.concatenate([np.flatnonzero(own == i)[:landmarks] for i in range(len(languages))])
    marks = [spectrum.grams(rows[i][1]) for i in chosen]
    grams = np.unique(np.concatenate(marks))
    presence = np.zeros((len(marks), len(grams)), np.float32)
    for row, m in zip(presence, marks):
        row[np.searchsorted(grams, m)] = 1
    presence /= np.sqrt(presence.sum(1, keepdims=True))
    model = Model(spectrum, languages, grams, presence, np.zeros((len(marks), len(languages))))
    texts = [text for _, text in rows]
    k = np.concatenate([model.features(texts[i:i + ROWS]) for i in range(0, len(texts), ROWS)])
    target = np.where(own[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = (len(rows) / (len(languages) * np.bincount(own)))[own]  # each language counts alike
    between = (presence @ presence.T).astype(np.float64)
    gram = (k * weight[:, None]).T @ k + ridge * between + 1e-6 * len(rows) * np.eye(len(marks))
    return Model(spectrum, languages, grams, presence, np.linalg.solve(gram, k.T @ (weight[:, None] * target)))


def fit(labelled: DataFrame, per_language: int = 400, **options) -> Model:
    """Model from ``labelled`` (doc_id, lang, text); rows without lang or letter are not used. No rows give a model that knows nothing."""
    return fitted(sample(labelled, per_language), **options)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, from ``text`` alone. Columns of these names are replaced.

    A null, empty or letterless text is ``und`` with score 0. The model (landmarks
    by their n-grams) travels with the tasks.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    names_out = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=names_out)

    return docs.mapInArrow(run, schema)


def held_out(docs: DataFrame):
    """True for the rows that no model is fitted on: crc32 of doc_id as text, modulo 5, is 0 (a null doc_id is as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identified(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with held_out, lang_pred and score, by a model fitted on its rows that are not held out."""
    name = free_name(docs, "out_of_fit")
    model = fit(docs.where(~held_out(docs)), **options)
    rows = docs.drop("held_out", "lang_pred", "score")
    return identify(rows.withColumn(name, held_out(docs)), model).withColumnRenamed(name, "held_out")
