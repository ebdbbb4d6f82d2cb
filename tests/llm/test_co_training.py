import random

import numpy as np

from quillspan.llm.co_training import CoTrained, Logistic, Rows, _line, featured, judged, scored, train


def corpus(n=500, seed=6):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        good, bad = r.random() < 0.7, r.random() < 0.25
        if good:
            w = [r.choice(words) for _ in range(r.choice([20, 60, 200]))]
        else:
            w = [x.upper() + "!!" for x in [r.choice(words) for _ in range(8)] * 8]
        if bad:
            for x in ("vile", "nasty", "foul"):
                w.insert(r.randrange(len(w)), x)
        rows.append((i, " ".join(w), r.choice(["en", None]), f"s{i % 5}"))
        labels.append((i, int(good), int(bad)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    odd = [(9000, None, None, None), (9001, "", "en", "s1"), (None, "vile nasty foul w1", "en", "s1"), (5, rows[5][1], rows[5][2], rows[5][3])]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as quality", "2 as keep").repartition(3)
    lab = spark.createDataFrame([x for x in labels if x[0] % 2] + [(77, None, None)], "doc_id long, quality int, toxic int")
    out = judged(df, lab).collect()
    assert len(out) == len(rows) + len(odd)
    truth = {d: (q, t) for d, q, t in labels}
    held = [x for x in out if x.doc_id is not None and x.doc_id in truth and x.doc_id % 2 == 0]
    assert np.mean([(x.quality >= 0.5) == truth[x.doc_id][0] for x in held]) > 0.97
    assert np.mean([(x.toxic >= 0.5) == truth[x.doc_id][1] for x in held]) > 0.9
    assert all(0 <= x.quality <= 1 and x.keep == (x.quality >= 0.5 and x.toxic < 0.5) for x in out)
    assert len({tuple(x) for x in out if x.doc_id == 5}) == 1


def test_no_labels_and_empty(spark):
    rows, labels = corpus(20)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(x.quality, x.toxic) for x in judged(df, none).collect()} == {(0.5, 0.5)}
    one = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert {(x.quality, x.toxic, x.keep) for x in judged(df, one).collect()} == {(1.0, 0.0, True)}
    assert judged(df.limit(0), one).collect() == []


def taught_corpus():
    """Two kinds of pages: many words that tell them apart, each rare, and sources that nearly do."""
    r = random.Random(3)
    rows, truth = [], {}
    for i in range(3000):
        kind = int(r.random() < 0.5)
        words = [f"k{kind}x{r.randrange(350)}" if r.random() < 0.25 else f"n{r.randrange(3000)}" for _ in range(14)]
        told = ["ab"[kind if r.random() < 0.95 else 1 - kind] for _ in "12"]
        rows.append((i, " ".join(words), "x" + told[0], f"site-{told[1]}.example.org"))
        truth[i] = kind
    return rows, truth


def test_views_teach_each_other_over_the_corpus(spark):
    """With few labels, what each view is sure of in all rows makes the other better on held-out rows, and the whole no worse."""
    rows, truth = taught_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    lab = spark.createDataFrame([(i, k, int(i % 7 == 0)) for i, k in truth.items() if i < 400], "doc_id long, quality int, toxic int")
    features = featured(df)
    got = {}
    for rounds in (0, 3):
        out = scored(features, train(features, lab, ("quality",), rounds=rounds, grow=1.0)).collect()
        held = [x for x in out if x.doc_id >= 400]
        got[rounds] = [np.mean([(x[c] >= 0.5) == truth[x.doc_id] for x in held]) for c in ("quality_content", "quality")]
    assert got[3][0] > got[0][0] + 0.03, got
    assert got[3][1] >= got[0][1] - 0.005, got


def test_what_makes_a_view_worse_is_taken_back():
    r = np.random.default_rng(1)
    y = (r.random(400) < 0.5).astype(float)
    x = Rows((y + 2 * r.integers(0, 40, 400)).astype(np.int64), np.ones(400, np.int64))
    model = CoTrained((x, x), y)
    before = model.views[0].w.copy()
    wrong = x.take(np.arange(300))
    assert not model.teach(0, wrong, 1 - y[:300]) and (model.views[0].w == before).all()
    assert model.teach(1, wrong, y[:300])


def test_whole_names_and_long_texts(spark):
    from quillspan.llm.co_training import _name

    assert _name("a.very.long.host.example.org") != _name("b.very.long.host.example.org") and _name(None) != _name("None")
    rows, labels = corpus(60)
    df = spark.createDataFrame([*rows, (900, "word " * 200_000, "en", "s1")], "doc_id long, text string, lang string, source string")
    out = judged(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == 61 and all(0 <= x.quality <= 1 for x in out)


def test_small_fits():
    x = Rows(np.array([0, 1, 0, 1]), np.array([1, 1, 1, 1]))
    m = Logistic(2).fit(x, np.array([1.0, 0, 1, 0]))
    assert (m.score(x) > 0).tolist() == [True, False, True, False]
    w = _line(np.array([[1.0], [2], [3], [4]]), np.array([0.0, 0, 1, 1]))
    assert w[0] > 0 and abs(w[0] * 2.5 + w[1]) < 0.3


def test_no_row_is_told_twice(spark):
    """Every round offers a view rows that it was not offered before, and later rounds still find some."""
    rows, truth = taught_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    lab = spark.createDataFrame([(i, k, int(i % 7 == 0)) for i, k in truth.items() if i < 400], "doc_id long, quality int, toxic int")
    seen = []
    train(featured(df), lab, ("quality", "toxic"), rounds=3, grow=0.2, watch=seen.append)
    assert len(seen) == 3 and all(sum(map(len, offers.values())) > 0 for offers in seen)
    for target in ("quality", "toxic"):
        for view in (0, 1):
            told = [r for offers in seen for label in (0, 1) for r in offers[target, view, label]]
            assert len(told) == len(set(told))
            assert len(told) <= 3 * (0.2 * 250 + 2)
