import random

import numpy as np
from pyspark.sql import functions as F

from quillspan.llm.arrays import Words, connected, first_rows, pieces, runs_of, shingle_sets, sized


def test_words_and_runs():
    texts = [b"", b" a  bb\tccc ", "é x y".encode(), b"a", b"bb a", b"x" * 3000]
    w = Words(texts)
    assert w.counts.tolist() == [0, 3, 2, 1, 2, 1]
    words = [bytes(w.buf[a:b]) for a, b in zip(w.starts, w.ends, strict=True)]
    assert words == [x for t in texts for x in t.split()]
    by = {}
    for word, h in zip(words, w.hashes.tolist(), strict=True):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)
    again = Words([b"zz a bb ccc"])
    assert runs_of(again.hashes, 3)[1] == runs_of(w.hashes, 3)[0]
    assert Words([b"AbC \xc3\x89"], lower=True).hashes.tolist() == Words([b"abc \xc3\x89"]).hashes.tolist()


def test_shingle_sets_do_not_cross_texts():
    a, b, c, d = shingle_sets([b"a b c d e f", b"a b c d e", b"f a b c d e", b"a b"])
    assert len(a) == 2 and len(b) == 1 and len(d) == 1 and set(b) <= set(a) & set(c) and not set(d) & set(a)


def test_pieces():
    assert list(pieces([b"aaa", b"bb", b"", b"cccccc", b"d"], 5)) == [(0, 3), (3, 4), (4, 5)] and list(pieces([])) == []


def test_connected(spark):
    r = random.Random(1)
    links = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 60)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    own = {x for p in links for x in p if p[0] != p[1]}
    got = {x.id: x.root for x in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in own}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_first_rows_and_size(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 10).alias("h"))
    assert sorted({x.h for x in first_rows(df, "h", 3).collect()}) == [0, 1, 2] and first_rows(df, "h", 3).count() == 30
    assert first_rows(df.limit(0), "h", 3).count() == 0
    assert np.array_equal(sized(df).count(), 100)


def test_bytes_decide_over_broadcasts(spark, monkeypatch):
    import quillspan.llm.arrays as arrays

    df = spark.range(100).select(F.col("id"), F.repeat(F.lit("x"), 1000).alias("t"), F.struct(F.array(F.col("id")).alias("a")).alias("s"))
    asked = []
    monkeypatch.setattr(arrays.F, "broadcast", lambda x: asked.append(1) or x)
    monkeypatch.setattr(arrays, "BROADCAST_BYTES", 110_000)
    assert sized(df).count() == 100 and len(asked) == 1
    monkeypatch.setattr(arrays, "BROADCAST_BYTES", 90_000)
    assert sized(df).count() == 100 and len(asked) == 1
