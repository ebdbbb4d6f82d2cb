import hashlib

import numpy as np
import pytest

from quillspan.llm import centroids
from quillspan.llm.centroids import Centroids, Rotation, clustered


def brute(rows, k=40, rounds=5, width=64):
    kept = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == width and None not in v and np.isfinite(np.array(v, float)).all()]
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in kept if np.abs(v).max() < centroids.LIMIT / 256]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(x) for _, x in named[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(centres)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [(i, *nearest(x)) for i, x in kept]
    return sorted(((i, j, d, sum(e for _, e, h in found if h == j), sum(e for _, e, _ in found), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def got(spark, rows, parts=4, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "'x' as ints", "2 as distance").repartition(parts)
    return sorted((tuple(r)[:6] for r in clustered(df, **how).collect()), key=str)


def test_matches_brute_force(spark):
    r = np.random.default_rng(4)
    middles = r.normal(size=(12, 64))
    rows = [(i, (middles[i % 12] + r.normal(size=64) * r.choice([0.01, 0.5])).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [rows[3]] * 5 + [(3, rows[9][1])]  # copies, and an id on several rows
    rows += [(None, rows[5][1]), (None, rows[6][1]), (2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None] + [1.0] * 63), (2004, [float("nan")] * 64), (2005, [float("-inf")] * 64), (2006, [1e300] * 64), (2007, [-3e5] * 64), (2008, [0.0] * 64)]
    want = brute(rows)
    assert got(spark, rows) == want and len(want) == 400 + 66 + 2 + 1
    assert got(spark, rows, parts=1) == want


@pytest.mark.parametrize("n", [0, 1, 5, 39])
def test_fewer_rows_than_centroids(spark, n):
    r = np.random.default_rng(n)
    rows = [(i, r.normal(size=64).tolist()) for i in range(n)] + [(None, None)]
    assert got(spark, rows) == brute(rows)


def test_without_ids_and_all_equal(spark):
    rows = [(None, [float(i)] * 64) for i in range(3)] + [(None, [0.0] * 64)] * 50
    assert got(spark, rows) == brute(rows)


def test_bound_and_what_it_rules_out():
    """No bound is above a distance, and on vectors of few directions most centroids are never looked at."""
    r = np.random.default_rng(8)
    base = r.normal(size=(4, 64)) * [[900], [500], [300], [100]]
    x = np.floor(r.normal(size=(3000, 4)) @ base + r.normal(size=(3000, 64))).astype(np.int64)
    values, axes = np.linalg.eigh(np.cov(x.T.astype(float)))
    rotation = Rotation(axes[:, ::-1], 4)
    centres = Centroids(x[:40], rotation)
    exact = ((x[:, None, :] - x[None, :40, :]) ** 2).sum(axis=2)
    assert (centres.bounds(*rotation.of(x)) <= exact).all()
    number, distance, seen = centres.nearest(x, *rotation.of(x))
    assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and seen.mean() < 4


def test_leading_axes_follow_the_share(spark):
    r = np.random.default_rng(9)
    flat = r.normal(size=(300, 3)) @ r.normal(size=(3, 64))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(flat)], "vec_id long, embedding array<double>")
    assert centroids.principal(rows, 64, 0.9).leading <= 3
    assert got(spark, [(i, v.tolist()) for i, v in enumerate(flat)], share=0.2) == brute([(i, v.tolist()) for i, v in enumerate(flat)])
