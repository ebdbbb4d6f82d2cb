import hashlib
import random
import re

import pytest

from quillspan.llm.substring_dedup import deduplicated


def brute(rows):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in docs:
        if d is not None:
            for i in range(len(w) - 12):
                k = tuple(w[i : i + 13])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and least[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as marks", "2 as uid").repartition(4)
    return sorted((tuple(r) for r in deduplicated(df, with_text=True).collect()), key=str)


def test_matches_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}é" for i in range(400)]
    rows = []
    passages = [[r.choice(words) for _ in range(n)] for n in (12, 13, 14, 15, 16, 17, 18, 19, 25, 60)]
    for i in range(120):
        text = [r.choice(words) for _ in range(r.choice([0, 3, 12, 13, 50]))]
        for _ in range(r.choice([0, 1, 2])):
            text[r.randrange(len(text) + 1) : 0] = r.choice(passages)
            text += [r.choice(words) for _ in range(r.randrange(9))]
        rows.append((i * 3 % 127, r.choice([" ", "\n", "  ", "\t"]).join(text)))
    rows += [(900, None), (901, ""), (902, rows[0][1]), (902, rows[5][1]), (902, rows[5][1]), (None, rows[7][1]), (903, " ".join(["a"] * 40)), (904, " ".join(["a"] * 20)), (905, "x y z")]
    assert got(spark, rows) == brute(rows)


def test_phrase_repeated_in_a_short_batch(spark):
    r = random.Random(5)
    words = [f"v{i}" for i in range(300)]
    passages = [[r.choice(words) for _ in range(30)] for _ in range(6)]
    rows = [(50, "say it once more please " * 600), (7, "say it once more please " * 300)]
    for i in range(40):
        text = [r.choice(words) for _ in range(40)]
        text[20:20] = r.choice(passages)
        rows.append((100 + i, " ".join(text)))
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("repeats,parts,batch", [(300, 1, 300), (700, 5, 255), (1000, 9, 1), (2500, 2, 256), (5000, 3, 37)])
def test_repeats_over_layouts(spark, repeats, parts, batch):
    """Phrases repeated hundreds to thousands of times, beside shared passages, whatever the parts and batches."""
    r = random.Random(repeats)
    words = [f"q{i}" for i in range(200)]
    passages = [[r.choice(words) for _ in range(n)] for n in (13, 20, 60)]
    rows = [(3, "a " * repeats), (9, "a " * (repeats // 2) + "b"), (2, "c " * 40), (7, "one two three " * (repeats // 3)), (6, "three one two " * (repeats // 4))]
    for i in range(30):
        text = [r.choice(words) for _ in range(30)]
        text[r.randrange(30) : 0] = r.choice(passages)
        rows.append((20 + i % 25, " ".join(text)))
    rows += [rows[0]] * 3 + [(None, "a " * 30)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key)
    try:
        spark.conf.set(key, str(batch))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted((tuple(x) for x in deduplicated(df, with_text=True).collect()), key=str) == brute(rows)
    finally:
        spark.conf.set(key, kept)


def test_small_buckets(spark, monkeypatch):
    import quillspan.llm.substring_dedup as s

    monkeypatch.setattr(s, "BUCKET_BYTES", 100)
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(80))) for i in range(40)]
    assert got(spark, rows) == brute(rows)


def test_very_long_text(spark):
    r = random.Random(2)
    words = [f"z{i}" for i in range(5000)]
    long = [r.choice(words) for _ in range(120_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[70_000:70_100])), (3, " ".join(long[119_990:]))]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("parts", [2, 3, 5, 9])
def test_all_rows_twice_in_another_order(spark, parts):
    """Two parts that hold the same rows in another order are two batches, each with a table of its own."""
    r = random.Random(parts)
    words = [f"u{i}" for i in range(3000)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    shared = some(40)
    rows = [(1, " ".join(some(60) + shared)), (2, " ".join(shared + some(230))), (3, " ".join(some(125))), (4, " ".join(some(55)))]
    rows += [(10 + i, " ".join(some(20) + r.choice([shared, some(15)]) + some(20))) for i in range(12)]
    layouts = [rows, [rows[0], *rows[2:], rows[1]], rows[::-1]] + [r.sample(rows, len(rows)) for _ in range(parts)]
    dealt = layouts[:parts]
    df = spark.createDataFrame(spark.sparkContext.parallelize([x for part in dealt for x in part], parts), "doc_id long, text string")
    assert df.rdd.getNumPartitions() == parts
    assert sorted((tuple(x) for x in deduplicated(df, with_text=True).collect()), key=str) == brute([x for part in dealt for x in part])
