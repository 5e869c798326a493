"""k-means with all starts, and all numbers of clusters, in one pass per step.

The centres of every start lie in one matrix. A pass over the rows finds each row's nearest centre of
every start by one matrix product, and sums rows by centre; the sums are combined in
tasks first and added in Spark, so a step reads the table once, however many starts
there are, and one row for each centre reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows that starts are drawn from (those of the least hash), and rows of a batch that are compared at a time.
POOL, ROWS = 2000, 4096


@dataclass
class Fit:
    """Centres of one start and the sum of squared distances to them."""

    centres: np.ndarray
    cost: float
    sizes: np.ndarray


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features]).astype(float)


def _chunks(batches: Iterator[pa.RecordBatch], features: list[str]) -> Iterator[np.ndarray]:
    for b in batches:
        x = _matrix(b, features)
        for low in range(0, len(x), ROWS):
            yield x[low:low + ROWS]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0.0)


def seeded(pool: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of the pool, each drawn with a chance in proportion to its squared distance from those before (k-means++)."""
    picked = [pool[rng.integers(len(pool))]]
    while len(picked) < k:
        far = _distances(pool, np.array(picked)).min(1)
        picked.append(pool[rng.choice(len(pool), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(pool))])
    return np.array(picked)


def _step(rows: DataFrame, features: list[str], starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sums of features and squared distances by centre, over all starts."""
    edges = np.cumsum([0, *map(len, starts)])
    known = rows.sparkSession.sparkContext.broadcast(np.concatenate(starts))
    d = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = known.value
        total = np.zeros((len(centres), d + 2))
        for x in _chunks(batches, features):
            far = _distances(x, centres)
            for low, high in zip(edges, edges[1:]):
                near = far[:, low:high].argmin(1)
                least = far[np.arange(len(x)), low + near]
                cells = np.column_stack([np.ones(len(x)), x, least])
                total[low:high] += np.column_stack([np.bincount(near, c, high - low) for c in cells.T])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres))), *(pa.array(c) for c in total.T)], names=["centre", *names])

    names = [f"c{i}" for i in range(d + 2)]
    schema = "centre long, " + ", ".join(f"{n} double" for n in names)
    summed = rows.select(*features).mapInArrow(run, schema).groupBy("centre").agg(*[F.sum(n).alias(n) for n in names])
    out = np.zeros((int(edges[-1]), d + 2))
    for r in summed.collect():  # one row for each centre
        out[r[0]] = r[1:]
    known.destroy()
    return out[:, 0], out[:, 1:-1], out[:, -1]


def fits(rows: DataFrame, features: list[str], wanted: list[tuple[int, int]], max_steps: int = 20, tolerance: float = 1e-4) -> list[Fit]:
    """A fit for each (clusters, seed) of ``wanted``. ``rows`` is staged; features have no NULL.

    A start that stands still takes no further part. A cluster without rows keeps its centre.
    """
    pool = rows.select(*features, F.xxhash64(*features).alias("_h")).orderBy("_h", *features).limit(POOL).drop("_h").toPandas().to_numpy(float)
    if not len(pool):
        raise ValueError("no row to cluster")
    centres = [seeded(pool, k, np.random.default_rng([seed, k])) for k, seed in wanted]
    done: list[Fit | None] = [None] * len(wanted)
    for step in range(max_steps + 1):
        active = [i for i, f in enumerate(done) if f is None]
        if not active:
            break
        n, sums, cost = _step(rows, features, [centres[i] for i in active])
        low = 0
        for i in active:
            high = low + len(centres[i])
            here = n[low:high]
            moved = np.where(here[:, None] > 0, sums[low:high] / np.maximum(here, 1)[:, None], centres[i])
            if step == max_steps or ((moved - centres[i]) ** 2).sum(1).max() <= tolerance ** 2:
                done[i] = Fit(centres[i], float(cost[low:high].sum()), here)
            else:
                centres[i] = moved
            low = high
    return done


def best_of(rows: DataFrame, features: list[str], ks: list[int], starts: int, seed: int) -> dict[int, Fit]:
    """For each number of clusters the cheapest of ``starts`` starts; all are fitted together."""
    wanted = [(k, seed + s) for k in ks for s in range(starts)]
    out: dict[int, Fit] = {}
    for (k, _), fit in zip(wanted, fits(rows, features, wanted)):
        if k not in out or fit.cost < out[k].cost:
            out[k] = fit
    return out


def silhouettes(rows: DataFrame, features: list[str], found: dict[int, Fit]) -> dict[int, float]:
    """Mean silhouette (squared Euclidean) of each fit: one pass for the clusters' sums, one for the rows; a cluster of one row counts 0."""
    ks = list(found)
    n, sums, spread = _sums(rows, features, [found[k].centres for k in ks])
    edges = np.cumsum([0, *(len(found[k].centres) for k in ks)])
    known = rows.sparkSession.sparkContext.broadcast((np.concatenate([found[k].centres for k in ks]), n, sums, spread))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, size, total, squared = known.value
        score, count = np.zeros(len(ks)), 0
        for x in _chunks(batches, features):
            count += len(x)
            near_all = _distances(x, centres)
            # sum over a cluster's rows y of |x - y|^2
            away = np.maximum((x * x).sum(1)[:, None] * size - 2 * x @ total.T + squared, 0.0)
            for i, (low, high) in enumerate(zip(edges, edges[1:])):
                own, at = near_all[:, low:high].argmin(1), np.arange(len(x))
                m = size[low:high]
                inside = away[at, low + own] / np.maximum(m[own] - 1, 1)
                mean = np.where(m > 0, away[:, low:high] / np.maximum(m, 1), np.inf)
                mean[at, own] = np.inf
                outside = mean.min(1)
                top = np.maximum(inside, outside)
                ok = (m[own] > 1) & np.isfinite(outside) & (top > 0)
                score[i] += np.where(ok, (np.where(ok, outside, 0) - inside) / np.where(ok, top, 1), 0.0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ks))), pa.array(score), pa.array(np.full(len(ks), float(count)))], names=["fit", "score", "n"])

    got = rows.select(*features).mapInArrow(run, "fit long, score double, n double").groupBy("fit").agg(F.sum("score").alias("score"), F.sum("n").alias("n")).collect()
    return {ks[r.fit]: r.score / r.n if r.n else 0.0 for r in got}


def _sums(rows: DataFrame, features: list[str], starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sums of features, and sums of squared lengths by centre."""
    n, sums, cost = _step(rows, features, starts)
    centres = np.concatenate(starts)
    # sum |y - c|^2 = sum |y|^2 - 2 c . sum y + n |c|^2
    return n, sums, cost + 2 * (centres * sums).sum(1) - n * (centres * centres).sum(1)


def nearest(df: DataFrame, features: list[str], centres: np.ndarray, name: str = "cluster"):
    """Number of the nearest centre as a column; ties go to the first."""
    far = F.array(*[F.struct(sum(((F.col(c) - float(v)) ** 2 for c, v in zip(features, centre)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, centre in enumerate(centres)])
    return df.withColumn(name, F.array_min(far)["i"])
