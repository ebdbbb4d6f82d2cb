import numpy as np
import pytest

from quillspan.llm import hard_negatives as hard
from quillspan.llm.hard_negatives import Anchors, SharedList, dots, hard_negatives


def brute(rows, every=100, k=5):
    kept = [(i, lab, v) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all()]
    if not kept:
        return []
    sizes = [len(v) for _, _, v in kept]
    width = min(set(sizes), key=lambda n: (-sizes.count(n), n))
    kept = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in kept if len(v) == width and max(map(abs, v)) < int((hard.MOST_SCORE / width) ** 0.5) // 256]
    out = []
    for a in sorted({i for i, _, _ in kept if i % every == 0}):
        _, label, x = min((i, lab, v) for i, lab, v in kept if i == a)
        scored = sorted((-sum(p * q for p, q in zip(x, v, strict=True)), i, lab) for i, lab, v in kept if i != a)
        for s, p, _ in [t for t in scored if t[2] == label][:k]:
            fits = [t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s][:k]
            out += [(a, p, rank + 1, n, -s, -t) for rank, (t, n, _) in enumerate(fits)]
    return sorted(out)


def got(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as anchor_id", "2 as score", "3 as rank").repartition(parts)
    return sorted(tuple(r) for r in hard_negatives(df).collect())


def odd(rows):
    return rows + [(None, rows[0][1], 1), (7001, rows[0][1], None), (7100, None, 1), (7200, [], 1), (7300, [None, *rows[0][1][1:]], 1), (7400, [float("nan")] * 16, 1), (7500, [float("inf")] * 16, 1), (7600, [1.0, 2.0], 1), (7700, [1e200] * 16, 1), (7800, [0.0] * 16, 2)]


@pytest.mark.parametrize("parts,block,step,anchors", [(4, 8192, 1024, 4096), (1, 50, 7, 4096), (3, 300, 64, 6)])
def test_matches_brute_force(spark, monkeypatch, parts, block, step, anchors):
    for name, value in (("BLOCK", block), ("STEP", step), ("ANCHORS", anchors), ("MEMBERS", 4)):
        monkeypatch.setattr(hard, name, value)
    r = np.random.default_rng(parts)
    middles = r.normal(size=(6, 16))
    rows = [(i * 10, (middles[i % 6] + 0.4 * r.normal(size=16)).tolist(), int(r.integers(4))) for i in range(500)]
    rows += [(6000 + i, rows[10][1], 3) for i in range(40)] + [(6100 + i, rows[10][1], 2) for i in range(40)]  # one vector, often
    rows += [rows[20]] * 3 + [(200, rows[30][1], 1), (40, rows[31][1], 0)]  # an anchor's id, and another, on several rows
    want = brute(odd(rows))
    assert want and got(spark, odd(rows), parts) == want


@pytest.mark.parametrize("rows", [[], [(100, None, 1)], [(100, [1.0, 2.0], 1)], [(100, [1.0, 2.0], 1), (101, [1.0, 2.0], 1)], [(100, [1.0], 1), (101, [-1.0], 1), (102, [-1.0], 2), (103, [0.5], 3)], [(0, [0.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [3.0, 1.0], 2)]])
def test_small(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    r = np.random.default_rng(2)
    big = float(int((hard.MOST_SCORE / 16) ** 0.5) // 256) * 0.99
    rows = [(i * 50, (big * r.choice([0.95, 0.97, 1.0], size=16)).tolist(), i % 3) for i in range(60)]
    assert got(spark, rows) == brute(rows) != []


def test_bounds_hold_and_end_walks(monkeypatch):
    monkeypatch.setattr(hard, "STEP", 64)
    monkeypatch.setattr(hard, "MEMBERS", 8)
    r = np.random.default_rng(5)
    middles = r.normal(size=(5, 32)) * 200
    x = np.floor(middles[r.integers(5, size=4000)] + 10 * r.normal(size=(4000, 32))).astype(np.int64)
    labels = r.integers(3, size=4000)
    anchors = Anchors(np.arange(0, 4000, 40), labels[::40], x[::40])
    norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    for centre, widest, members in anchors.clusters:
        bound = SharedList(x, norms, centre, widest).bound
        assert (dots(anchors.x[members], x) <= anchors.norms[members][:, None] * bound).all()
    walks = hard.Positives(anchors, 5)
    assert walks.see(np.arange(4000), labels, x) < 0.7 * sum((labels == lab).sum() for lab in anchors.labels)
