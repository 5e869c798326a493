"""k-means of many starts against plain numpy."""

import numpy as np
import pytest

from stockloom.operators import clusters as cl

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.5, (n, 3)) for m, n in ((0, 300), (6, 120), (-7, 40))])
    return x, spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in NAMES)).repartition(5)


def lloyd(x, centres, steps=20, tolerance=1e-4):
    for step in range(steps + 1):
        far = ((x[:, None] - centres) ** 2).sum(2)
        near = far.argmin(1)
        moved = np.array([x[near == i].mean(0) if (near == i).any() else centres[i] for i in range(len(centres))])
        if step == steps or ((moved - centres) ** 2).sum(1).max() <= tolerance ** 2:
            return centres, far.min(1).sum(), near
        centres = moved


def test_each_start_equals_plain_steps(spark, blobs):
    x, df = blobs
    wanted = [(k, s) for k in (1, 2, 3, 5) for s in (7, 8, 9)]
    found = cl.fits(df, NAMES, wanted)
    pool = df.selectExpr(*NAMES, "xxhash64(a, b, c) as h").orderBy("h", *NAMES).limit(cl.POOL).drop("h").toPandas().to_numpy(float)
    for (k, s), f in zip(wanted, found):
        centres, cost, near = lloyd(x, cl.seeded(pool, k, np.random.default_rng([s, k])))
        assert np.allclose(f.centres, centres) and f.cost == pytest.approx(cost) and f.sizes.tolist() == np.bincount(near, minlength=k).tolist()
    assert found[0].cost == pytest.approx(((x - x.mean(0)) ** 2).sum())


def test_best_fit_silhouette_and_assignment(spark, blobs):
    x, df = blobs
    found = cl.best_of(df, NAMES, [2, 3, 4], 6, 1)
    assert sorted(found[3].sizes.tolist()) == [40, 120, 300] and found[2].cost > found[3].cost > found[4].cost
    got = cl.silhouettes(df, NAMES, found)
    far = ((x[:, None] - x) ** 2).sum(2)
    for k, f in found.items():
        near = ((x[:, None] - f.centres) ** 2).sum(2).argmin(1)
        scores = []
        for i, own in enumerate(near):
            same = (near == own).sum()
            a = far[i, near == own].sum() / max(same - 1, 1)
            b = min(far[i, near == j].mean() for j in set(near) - {own})
            scores.append((b - a) / max(a, b) if same > 1 else 0.0)
        assert got[k] == pytest.approx(np.mean(scores))
    rows = cl.nearest(df, NAMES, found[3].centres).select(*NAMES, "cluster").collect()
    assert all(r.cluster == ((np.array(r[:3]) - found[3].centres) ** 2).sum(1).argmin() for r in rows)


def test_steps_do_not_grow_with_starts(spark, blobs):
    _, df = blobs
    passes = []
    one = cl._step
    cl._step = lambda rows, features, starts: passes.append(len(starts)) or one(rows, features, starts)
    try:
        cl.best_of(df, NAMES, [2, 3], 15, 3)
    finally:
        cl._step = one
    assert passes[0] == 30 and len(passes) <= 21 and passes == sorted(passes, reverse=True)


def test_few_equal_and_no_rows(spark):
    same = spark.createDataFrame([(1.0, 2.0, 3.0)] * 4, "a double, b double, c double")
    fit = cl.best_of(same, NAMES, [2], 2, 0)[2]
    assert fit.cost == 0 and cl.silhouettes(same, NAMES, {2: fit}) == {2: 0.0}
    with pytest.raises(ValueError):
        cl.best_of(same.limit(0), NAMES, [2], 2, 0)
