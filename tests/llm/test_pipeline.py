import random
import re

import corpus_pipeline
from quillspan.llm.mixing import mix_digest


def corpus():
    r = random.Random(9)
    langs = {"xa": "tion ing the er and", "xb": "keit ung der sch und"}
    rows = []
    for i in range(150):
        lang = r.choice(list(langs))
        parts = langs[lang].split()
        words = ["".join(r.choice(parts) for _ in range(r.choice([2, 3, 4]))) for _ in range(r.choice([3, 40, 120]))]
        if i % 10 == 3:
            words.insert(1, "password=abcdef1234567890")
        if i % 10 == 5 and rows:
            words = rows[-1][1].split()
        rows.append((i, " ".join(words), lang, r.choice("pqr"), 0))
    return rows + [(500, None, "xa", "p", 0), (501, "12 34", "xa", "q", 2), (502, rows[4][1], "xb", "q", 1), (502, rows[4][1], "xb", "q", 1)]


def test_stages(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, None)
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs.collect()
    first = seen["language ID"]
    assert {r.doc_id for r in first} == {r[0] for r in rows} - {500, 501} and len(first) == len(rows) - 2
    kept = {r.doc_id for r in seen["n-gram Jaccard join"]}
    assert len(kept) == len(seen["n-gram Jaccard join"]) and 502 not in kept
    texts = {r[0]: r[1] for r in rows}
    assert all(i in kept for i in range(150) if i % 10 != 5 and list(texts.values()).index(texts[i]) == list(texts).index(i))
    clean = seen["secret scan"]
    assert {r.doc_id for r in clean} == kept and not any(re.search("password=a", r.text) for r in clean)
    assert all("[SECRET]" in r.text and r.n_chars == len(r.text) for r in clean if "password=" in texts[r.doc_id])
    want = {r.doc_id: r.taken // r.size for r in mix_digest(spark.createDataFrame(clean)).collect() if r.size}
    got = {}
    for r in seen["mixing"]:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in want.items() if n}
    packed = seen["packing"]
    assert sorted(r.doc_id for r in packed if r.piece == 0) == sorted(r.doc_id for r in seen["mixing"])
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048


def test_one_of_each_decides_by_row(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcdefg"}
    rows = [(1, text["a"]), (5, text["a"] + " more"), (5, text["b"]), (5, text["c"]), (6, text["c"]), (7, text["d"]), (7, text["d"]), (None, text["e"]), (None, text["e"]), (None, text["f"]), (None, text["b"]), (8, ""), (8, None), (9, text["g"]), (9, text["g"] + " more")]
    docs = spark.createDataFrame([(d, t, "xa", "p", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, None).collect()]
    nine = [x for x in out if x[0] == 9]
    want = [(1, text["a"]), (5, text["b"]), (5, text["c"]), (7, text["d"]), (None, text["e"]), (None, text["f"]), (8, ""), (8, None)]
    assert len(nine) == 1 and sorted(map(str, want)) == sorted(str(x) for x in out if x[0] != 9)


def test_one_of_each_without_ids(spark):
    """Near copies without ids are one class; one row of it stays."""
    text = " ".join(f"n{i}" for i in range(40))
    rows = [(None, text), (None, text + " more"), (None, text + " else"), (3, "quite another text of some words")]
    docs = spark.createDataFrame([(d, t, "xa", "p", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, None).collect()]
    assert len(out) == 2 and (3, rows[3][1]) in out


def test_run_on_files(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 50


def test_stages_on_odd_tables(spark):
    """Each stage on an empty table, and with a long text, nulls and extra columns whose names the operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ["1 as score", "'s' as sid", "2 as root", "3 as mix_size", "'t' as spans", "4L as length", "5 as piece"]
    rows = [(1, "tion ing the er and " * 30_000, "xa", "p", 0), (2, None, None, None, None), (3, "", "xa", "p", 0), (4, "ung der sch und keit", "xb", "q", 0), (4, "ung der sch und keit", "xb", "q", 0), (None, "the password=abcdef1234567890 of it", "xa", "q", 0)]
    for docs in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        given = docs.selectExpr("*", *extra)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, None)
            found = out.collect()
            if name == "packing":
                assert len([r for r in found if r.piece == 0]) == given.count()
            else:
                assert out.columns == given.columns
                assert all((r.score, r.sid, r.root, r.mix_size, r.spans, r.length, r.piece) == (1, "s", 2, 3, "t", 4, 5) for r in found)
            if name == "secret scan":
                assert not any("abcdef1234567890" in (r.text or "") for r in found)
