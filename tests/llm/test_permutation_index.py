import numpy as np
import pytest

from quillspan.llm import permutation_index as index
from quillspan.llm.permutation_index import Permutations, footrule, search


def brute(rows, every=50, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    good = [(i, v) for i, v in good if len(v) == 16]
    out = {}
    for i, q in good:
        if i % every == 0:
            scored = sorted((-float((v * q).sum() / np.sqrt((v * v).sum() * (q * q).sum())), j) for j, v in good if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as query_id", "2 as rank").repartition(4)


def test_recall_and_scores(spark, monkeypatch):
    r = np.random.default_rng(0)
    monkeypatch.setattr(index, "QUERIES", 20)
    monkeypatch.setattr(index, "BLOCK", 700)
    x = r.normal(size=(3000, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = brute(rows), {}
    for row in search(frame(spark, rows)).collect():
        got.setdefault(row.query_id, {})[row["rank"]] = (row.vec_id, row.score)
    assert got.keys() == want.keys() and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    for q, g in got.items():
        for v, s in g.values():
            a, b = x[q].astype(float), x[v].astype(float)
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
        assert [g[k] for k in range(1, 6)] == sorted(g.values(), key=lambda p: (-p[1], p[0]))


def test_small_odd_and_tied(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=16).astype(np.float32).tolist()) for i in range(103)]
    rows += [(200 + i, rows[50][1]) for i in range(30)]
    rows += [(300, None), (350, []), (400, [0.0] * 16), (450, [None] + [1.0] * 15), (500, [float("nan")] * 16), (550, [float("inf")] * 16), (600, [1.0, 2.0]), (None, [1.0] * 16)]
    got = {}
    for row in search(frame(spark, rows)).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id))
    want = brute(rows)
    assert got.keys() == want.keys() and [v for _, v in sorted(got[50])] == [v for v, _ in want[50]] == [200, 201, 202, 203, 204]
    assert all(len(g) == 5 for g in got.values()) and sum(len({v for _, v in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.7 * 5 * len(want)
    assert search(frame(spark, rows[:3])).count() == 2


@pytest.mark.parametrize("rows", [[], [(50, None)], [(0, [1.0] * 16)]])
def test_empty(spark, rows):
    assert search(frame(spark, rows)).collect() == []


def test_bits_are_the_footrule():
    """The number of differing bits is the sum over pivots of how far their steps are apart."""
    r = np.random.default_rng(2)
    perms = Permutations(r.normal(size=(40, 8)))
    x = r.normal(size=(30, 8))
    _, bits = perms.of(x, 5)
    near = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ perms.pivots.T
    step = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1) * index.LEVELS // 40
    assert (footrule(bits, bits[0]) == np.abs(step - step[0]).sum(axis=1)).all()


def test_rows_do_not_depend_on_batches_or_parts(spark):
    r = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(2500, 16)).astype(np.float32))]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept, got = spark.conf.get(key), []
    try:
        for size, parts in ((10_000, 1), (100, 1), (10_000, 7)):
            spark.conf.set(key, str(size))
            df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
            got.append(sorted(map(tuple, search(df).collect())))
    finally:
        spark.conf.set(key, kept)
    assert got[0] == got[1] == got[2]


def test_footrule_decides_on_small_tables(spark, monkeypatch):
    """At 500 rows most are left out by the footrule, and recall holds."""
    r = np.random.default_rng(4)
    x = r.normal(size=(500, 64))
    perms = Permutations(x[:256])
    block = index.Block(np.arange(500), x, perms)
    nearest, bits = perms.of(x, index.PROBED)
    within = index.radii(bits, block.bits)
    sizes, hits = [], 0
    for q in range(0, 500, 10):
        found = block.candidates(nearest[q], bits[q], within[q])
        sizes.append(len(found))
        score = index.cosines(x, block.norms, x[q])
        score[q] = -2
        hits += len(set(np.argsort(-score)[:5]) & set(found))
    assert max(sizes) < 120 and hits >= 0.9 * 250


def test_copies_of_one_vector(spark):
    """A third of all rows equal: each query still gets the nearest, ties by id."""
    r = np.random.default_rng(5)
    x = r.normal(size=(900, 16)).astype(np.float32)
    x[300:600] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for row in search(frame(spark, rows)).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id))
    want = brute(rows)
    assert [v for _, v in sorted(got[350])] == [300, 301, 302, 303, 304]
    hits = sum(len({v for _, v in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert all(len(g) == 5 for g in got.values()) and hits >= 0.9 * 5 * len(want)
