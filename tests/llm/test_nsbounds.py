import hashlib
import math
import random

import numpy as np
import pytest

from ledgerlens.llm import nsbounds

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, dims, clusters, rounds):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) rows in Python's whole numbers."""
    sound = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in sound]
    digest = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    centres = [x for _, _, x in sorted((digest(i), k, x) for k, (i, x) in enumerate(kept))[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        where = [nearest(x)[1] for _, x in kept]
        for k in range(len(centres)):
            own = [x for (_, x), w in zip(kept, where) if w == k]
            if own:
                centres[k] = [sum(c) // len(own) for c in zip(*own)]
    found = [nearest(x) for _, x in kept]
    of = {k: sum(d for d, w in found if w == k) for _, k in found}
    return sorted(((str(i), k, d, of[k], sum(of.values()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest())
                   for (i, _), (d, k) in zip(kept, found)))


def some_rows(dims, n, seed=1, steps=None):
    """Vectors around a few points; with `steps`, on a coarse grid, so that many distances tie."""
    draw = random.Random(seed)
    points = [[draw.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        v = [c + draw.gauss(0, 0.3) for c in draw.choice(points)]
        rows.append((i, [round(c * steps) / steps for c in v] if steps else v))
    rows += [(n, None), (n + 1, []), (n + 2, [0.5] * (dims - 1)), (n + 3, [0.5] * (dims - 1) + [None]),
             (n + 4, [float("nan")] * dims), (n + 5, [float("inf")] + [0.0] * (dims - 1)), (None, [0.25] * dims), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("dims, steps", [(4, None), (3, 2), (64, None)])
def test_clusters_against_whole_numbers(spark, dims, steps):
    rows = some_rows(dims, 400, steps=steps)
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(3).withColumnRenamed("label", "cluster")
    got = nsbounds.cluster(docs, dims=dims).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in got) == plain(rows, dims, 8, 10)


def test_few_vectors_and_none(spark):
    assert nsbounds.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-0.3, 7.5])]
    got = nsbounds.cluster(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), dims=2).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in got) == plain(rows, 2, 8, 10)


def test_bounds_spare_work_and_hold():
    draw = np.random.default_rng(3)
    x = (draw.normal(size=(3_000, 8)) * 200 + draw.integers(0, 6, 3_000)[:, None] * 900).astype(np.int64)
    history = x[:6][None].copy()
    bounds = nsbounds.Bounds.first(x, history[0])
    rescans = []
    for _ in range(15):
        centres = np.array([x[bounds.cluster == k].mean(axis=0) if (bounds.cluster == k).any() else history[-1][k] for k in range(6)])
        history = np.concatenate([history, np.floor(centres).astype(np.int64)[None]])
        rescans.append(bounds.again(history))
        exact = np.stack([nsbounds.squared(x, c) for c in history[-1]], axis=1)
        assert (bounds.cluster == exact.argmin(axis=1)).all()
        ways = np.sqrt(((history - history[-1]) ** 2).sum(axis=2))[bounds.seen, np.arange(6)]
        assert (np.abs(np.sqrt(exact) - bounds.near) <= ways * (1 + 1e-6) + 0.1).all()
    assert sum(rescans[5:]) < 0.2 * len(x) * len(rescans[5:])
