import math
import random
import re

from pyspark.sql import functions as F

from quillspan.llm.mixing import LEVELS, SEED, mix_digest, mixed


def targets(sizes):
    """Shares by weight, capped at three times a source's words, the excess shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: share.get(s, 3 * sizes[s]) for s in names}
        capped |= over


def test_matches_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(900):
        s = r.choice(["a"] * 20 + ["b", "b", "B", "é", "z0", "z1", None])
        rows.append((i, " ".join(["w"] * r.choice([1, 5, 40, 300])) if r.random() < 0.97 else r.choice([None, "", " \t"]), s))
    rows += [(5000, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    us = {x.doc_id: x.u for x in df.select("doc_id", ((F.xxhash64(F.xxhash64("doc_id", "text", "source"), F.lit(0).cast("long"), F.lit(SEED)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)).alias("u")).collect()}
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    by = {}
    for d, _, s in rows:
        by.setdefault(s, []).append(d)
    want = targets({s: sum(size[d] for d in ds) for s, ds in by.items()})
    favour = {d: math.exp(math.floor(math.log(math.log2(n + 2)) * LEVELS + 0.5) / LEVELS) for d, n in size.items()}
    copies = {}
    for s, ds in by.items():
        low, high = 0.0, 1e6
        for _ in range(200):  # the rate at which capped copies come to the target
            rate = (low + high) / 2
            low, high = (rate, high) if sum(size[d] * min(3.0, rate * favour[d]) for d in ds) < want[s] else (low, rate)
        e = {d: min(3.0, high * favour[d]) if size[d] or any(size[x] for x in ds) else 0.0 for d in ds}
        sure = {d: int(e[d] + 1e-9) for d in ds}
        taken = sum(sure[d] * size[d] for d in ds)
        copies |= sure
        p = {d: e[d] - sure[d] for d in ds}
        q = {d: (us[d] / (1 - us[d])) / (p[d] / (1 - p[d])) for d in ds if p[d] > 1e-9}
        for d in sorted(q, key=lambda d: (q[d], size[d])):
            if taken + size[d] / 2 > want[s]:
                break
            taken += size[d]
            copies[d] += 1
    got = {x.doc_id: x for x in mix_digest(df.selectExpr("*", "0 as size", "1 as target", "'k' as cut")).collect()}
    assert len(got) == len(rows)
    for d, _, s in rows:
        assert got[d]["size"] == size[d] and got[d].source_size == sum(size[x] for x in by[s])
        assert abs(got[d].target - want[s]) < 1e-6 * max(1, want[s])
    assert sum(got[d].taken != copies[d] * size[d] for d in copies) <= 2 * len(by)  # a rounding at the cut
    for s, ds in by.items():
        assert abs(sum(got[d].taken for d in ds) - want[s]) <= 300
    assert got == {x.doc_id: x for x in mix_digest(df.repartition(2)).collect()}


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_digest(df).collect() == []
    one = spark.createDataFrame([(1, "a b c", None), (1, "a b c", None), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((x.doc_id, x.taken) for x in mix_digest(one).collect()) == [(1, 3), (1, 3), (2, 0)]
    none = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [x.taken for x in mix_digest(none).collect()] == [0, 0]


def test_favoured_documents_are_taken_more(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'a b c d' as text", "if(id % 4 = 0, 'x', 'y') as source", "if(id % 2 = 0, 1.0, 3.0) as good")
    got = mixed(df, favour=F.col("good")).groupBy("source", "good").agg(F.sum("mix_copies").alias("n"), F.first("mix_target").alias("t")).collect()
    y = {r.good: r.n for r in got if r.source == "y"}
    assert y[3.0] > 1.5 * y[1.0] / 2
    x = {r.good: r.n for r in got if r.source == "x"}
    assert sum(x.values()) > 0 and y[3.0] > y[1.0]
    assert abs(4 * sum(y.values()) - next(r.t for r in got if r.source == "y")) <= 4


def test_ties_and_null_ids_come_near_their_targets(spark):
    """A thousand equal rows, rows without id and rows of one id are split where the cut falls."""
    rows = [(None, "a b c d", "s0")] * 1000 + [(7, "a b c d", "s1")] * 1000 + [(7, f"a b c {i}", "s2") for i in range(1000)] + [(i, "a b c d", "s3") for i in range(1000)] + [(None, f"a b c {i}", None) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {}
    for n in (1, 5):
        taken = F.col("mix_size") * F.col("mix_copies")
        out = mixed(df.repartition(n)).groupBy("source").agg(F.sum(taken).alias("taken"), F.first("mix_target").alias("target"), F.max(taken).alias("most")).collect()
        assert len(out) == 5 and all(abs(r.taken - r.target) <= 2 and r.most <= 12 for r in out), out
        got[n] = sorted(map(str, out))
    assert got[1] == got[5]


def test_capped_levels_reach_the_target(spark):
    """Very unequal favour: the favoured half is full at three copies, the rest takes what is left."""
    df = spark.range(2000).selectExpr("id as doc_id", "'a b' as text", "if(id < 500, 'p', 'q') as source", "if(id % 2 = 0, 100.0, 1.0) as good")
    out = mixed(df, weights=(3.0, 1.0), favour=F.col("good"))
    got = {(r.source, r.good): r for r in out.groupBy("source", "good").agg(F.sum("mix_copies").alias("n"), F.max("mix_copies").alias("most"), F.first("mix_target").alias("t")).collect()}
    for s in "pq":
        assert abs(2 * (got[s, 1.0].n + got[s, 100.0].n) - got[s, 1.0].t) <= 2
    assert got["p", 100.0].n == 750 and max(r.most for r in got.values()) == 3


def test_very_long_text(spark):
    rows = [(1, "w " * 300_000, "a")] + [(i, "a b c", "b") for i in range(2, 200)]
    got = {x.doc_id: x for x in mix_digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].size == 300_000 and got[1].taken in (300_000, 600_000) and len(got) == 199
