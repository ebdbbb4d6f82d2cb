import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions.text import content_hash
from quillspan.operators import diff, lexical, maintain, ranges, search
from quillspan.operators.embed import embed_chunks, hashed_words
from quillspan.operators.index import Params, index_batch
from quillspan.plans import catalog, views
from quillspan.schemas import CHUNKS, DOCUMENTS, EMBEDDINGS
from quillspan.sources import files as sources
from quillspan.sources.files import scan_files, wide_index, write_files
from quillspan.sources.store import empty_index, read_index, write_index
from quillspan.streaming.index_stream import index_stream



def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def files(spark, texts):
    df = spark.createDataFrame([(p, t, "text") for p, t in texts.items()], "file_path string, content string, language string")
    return df.withColumn("hash", content_hash(F.col("content")))


def state(ix):
    return (
        sorted((r.file_path, r.hash) for r in ix.documents.collect()), sorted((r.id, r.content) for r in ix.chunks.collect()),
        sorted((r.chunk_id, tuple(r.embedding)) for r in ix.embeddings.collect()),
    )


def test_scan(spark, tmp_path):
    for p, t in {"src/a.ts": "x", "src/b.js": "yé", "src/c.md": "z", "node_modules/d.ts": "w", "e.test.ts": "v"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {r.file_path: (r.content, r.language) for r in scan_files(spark, str(tmp_path), ["**/*.ts", "src/*"], ["*.test.ts", "node_modules/**"]).collect()}
    assert got == {"src/a.ts": ("x", "typescript"), "src/b.js": ("yé", "javascript")}


def test_files_left_out_are_not_opened(spark, tmp_path):
    """Paths decide while tasks are planned: the scan's files are the chosen ones, odd names included."""
    for p in ("src/a b%20é.ts", "src/deep/x.ts", "node_modules/m/y.ts", "build/z.ts", "src/w.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    found = scan_files(spark, f"file:{tmp_path}/", ["**/*.ts"], ["node_modules/**", "build/**"])
    plan = found._jdf.queryExecution().executedPlan()
    assert {r.file_path: r.content for r in found.collect()} == {p: p for p in ("src/a b%20é.ts", "src/deep/x.ts")}
    leaf = plan.collectLeaves().head()
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head() if leaf is None else leaf
    leaf.execute().count()
    assert leaf.metrics().apply("numFiles").value() == 2


def test_small_files_share_tasks(spark, tmp_path):
    """Spark alone plans four files a task here, as it counts 4 MB for opening one."""
    for k in range(400):
        (tmp_path / f"{k % 7}").mkdir(exist_ok=True)
        (tmp_path / f"{k % 7}/{k}.ts").write_text(f"file {k}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        found = scan_files(spark, str(tmp_path), ["**/*.ts"], [])
        assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert {r.file_path: r.content for r in found.collect()} == {f"{k % 7}/{k}.ts": f"file {k}" for k in range(400)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("root", ["{}", "file://{}", "viewfs://groups/t"])
def test_large_trees_are_scanned_by_groups(spark, tmp_path, monkeypatch, root):
    """No listing holds more files than it may, but for a folder without folders; what Spark's listing leaves out stays out, and names are no patterns."""
    names = [f"{d}/{k}.ts" for d in ("flat", "mixed") for k in range(9)] + ["mixed/in/z.ts", "top.ts", "[id]/page.ts", "a b%20{x}/é*.ts", "src/deep/er/x.ts", "src/y.js", "k=1/_z=2.ts", "build/out.ts", ".git/h.ts", "_private/p.ts", "src/.hidden.ts"]
    for p in names:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.groups.link./t", f"file://{tmp_path}")
    patterns = ["**/*.ts", "*.ts"], ["build/**"]
    root = root.format(tmp_path)
    whole = {r.file_path: r.content for r in scan_files(spark, root, *patterns).collect()}
    assert whole == {p: p for p in names if p.endswith(".ts") and not p.startswith(("build", ".git", "_private", "src/.h"))}
    monkeypatch.setattr(sources, "SCAN_FILES", 5)
    groups = sources._groups(spark, root)
    sizes = [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(g).count() for g in groups]
    assert sorted(sizes)[-1] == 9 and sorted(sizes)[-2] <= 5 and groups[sizes.index(9)][0].endswith("/flat")
    found = scan_files(spark, root, *patterns)
    assert {r.file_path: r.content for r in found.collect()} == whole and found.count() == len(whole)


#: Ids that begin alike or come twice, and sources and texts that file names and lines could break.
ODD = [(k, f"text {k}", ("en", "fr", "de", "es")[k % 4], f"s{k % 3}") for k in range(300)] + [
    (-3, "below zero", "en", "s1"), (205, "again", "en", "s1"), (206, "", "fr", "s2"), (207, "a\n\nb\r\n", "de", "s0"), (2000, "x", "en", "a b/c=d"), (2001, "y", "en", "50%+é*"), (2002, "z", "en", None), (None, "no id", "en", "s0"), (2003, "no language", None, "s0"),
]


def _odd(spark, tmp_path):
    import duckdb

    spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/in/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/in/documents.parquet/*.parquet'")
    return f"{tmp_path}/in", sorted(map(str, db.execute(catalog.oracle_sql()["scanned_files"]).fetchall()))


def test_written_files_are_all_there_is(spark, tmp_path):
    """A document is one file: no checksums beside it, and no folder for each."""
    sf, expected = _odd(spark, tmp_path)
    views.written_files(spark, sf, f"{tmp_path}/tree")
    found = list((tmp_path / "tree").rglob("*"))
    assert sum(p.is_file() for p in found) == len(ODD) - 1
    assert sum(p.is_dir() for p in found) < len(ODD) / 2
    assert sorted(str(tuple(r)) for r in catalog.queries()["scanned_files"](spark, sf).collect()) == expected


def test_written_files_where_only_spark_reaches(spark, tmp_path):
    sf, expected = _odd(spark, tmp_path)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.trees.link./t", f"file://{tmp_path}")
    root = views.written_files(spark, sf, "viewfs://trees/t/tree")
    found = scan_files(spark, root, ["**/lang=en/**", "**/lang={fr,de}/**"], ["**/doc_id=1*/**"], {"txt": "text"})
    assert sorted(str(tuple(r)) for r in found.select(views.written_path(F.col("file_path")), "content", "hash", "language").collect()) == expected


def test_files_written_again_stay_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.ts", "one\n"), ("c.ts", "é")], "file_path string, content string")
    for _ in range(2):
        write_files(rows, f"{tmp_path}/tree")
    assert {str(p.relative_to(tmp_path / "tree")): p.read_text() for p in (tmp_path / "tree").rglob("*") if p.is_file()} == {"a/b.ts": "one\n", "c.ts": "é"}


def test_incremental_equals_rebuild(spark, tmp_path):
    one = {"a": "first\n\nsecond line", "b": "same", "c": "gone", "blank": "\n"}
    two = {"a": "first\n\nchanged line", "b": "same", "d": "new here", "blank": "\n"}
    p = Params(target=3, most=9)
    old = index_batch(files(spark, one), empty_index(spark), p, now())
    write_index(old, str(tmp_path), "p")
    later = F.lit("2025-01-01 00:00:00").cast("timestamp")
    new = index_batch(files(spark, two), read_index(spark, str(tmp_path), "p"), p, later)
    assert write_index(new, str(tmp_path), "p") == 2
    new = read_index(spark, str(tmp_path), "p")
    assert state(new) == state(index_batch(files(spark, two), empty_index(spark), p, now()))
    made = {r.file_path: r.created_at.year for r in new.documents.collect()}
    assert made == {"a": 2025, "b": 2024, "d": 2025}
    again = diff.diff_summary(diff.diff_snapshot(files(spark, two), new.documents)).first()
    assert tuple(again) == (1, 0, 3, 0)  # the file without chunks stays new
    assert state(index_batch(files(spark, two), new, p, later)) == state(new)
    assert read_index(spark, str(tmp_path), "other").chunks.count() == 0


def test_stream_equals_batches(spark, tmp_path):
    schema = "file_path string, content string, language string, arrived int"
    batches = [[("a", "v1", "text", 1), ("b", "keep", "text", 1)], [("a", "v2", "text", 2), ("a", "v3 last", "text", 3), ("c", "late", "text", 2)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        index_stream(stream, f"{tmp_path}/ix", "p", f"{tmp_path}/ck").awaitTermination()
    want = index_batch(files(spark, {"a": "v3 last", "b": "keep", "c": "late"}), empty_index(spark), None, now())
    assert state(read_index(spark, f"{tmp_path}/ix", "p")) == state(want)


def test_diff(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file_path string, hash string")
    old = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], "file_path string, hash string")
    assert {r.file_path: r.status for r in diff.diff_snapshot(new, old).collect()} == {"a": "new", "b": "unchanged", "c": "modified", "d": "deleted"}
    assert tuple(diff.diff_summary(diff.diff_snapshot(new.limit(0), old.limit(0))).first()) == (0, 0, 0, 0)


def test_keys_and_errors(spark):
    docs = spark.createDataFrame([("a", "1", None, None)], DOCUMENTS)
    out = maintain.insert_documents(docs, spark.createDataFrame([("a", "9"), ("b", "2"), ("b", "2")], "file_path string, hash string"), now())
    assert sorted((r.file_path, r.hash) for r in out.collect()) == [("a", "1"), ("b", "2")]
    chunks = spark.createDataFrame([("a__0", "a", 0, 1, "x", None)], CHUNKS)
    vectors = spark.createDataFrame([("a__0", [1.0], None)], EMBEDDINGS)
    new = lambda *ids: spark.createDataFrame([(i, "b", 0, 0, "y") for i in ids], "id string, file_path string, start_line int, end_line int, content string")
    assert maintain.insert_chunks(chunks, new("b__0"), now()).count() == 2
    for ids in (("a__0",), ("b__0", "b__0")):
        with pytest.raises(Exception, match="repeated id"):
            maintain.insert_chunks(chunks, new(*ids), now()).collect()
    with pytest.raises(Exception, match="repeated chunk_id"):
        maintain.insert_embeddings(vectors, spark.createDataFrame([("a__0", [1.0])], "chunk_id string, embedding array<float>"), now()).collect()
    with pytest.raises(Exception, match="no such document: zz"):
        maintain.get_documents(docs, spark.createDataFrame([("zz",)], "file_path string")).collect()
    assert maintain.get_documents(docs).count() == 1
    left, kept = maintain.remove_chunks(chunks, vectors, spark.createDataFrame([("a",), ("a",)], "file_path string"))
    assert left.count() == kept.count() == 0
    assert wide_index(docs, chunks, vectors).first().file_hash == "1"
    with pytest.raises(Exception, match="without chunk or document"):
        wide_index(docs, chunks, spark.createDataFrame([("q", [1.0], None)], EMBEDDINGS)).collect()
    assert [r.id for r in maintain.pending_embeddings(new("a__0", "n"), vectors).collect()] == ["n"]
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 3, "y"), ("l", 2, None)], "key string, at int, v string")
    assert sorted((r.key, r.v) for r in maintain.last_wins(rows, "key", "at").collect()) == [("k", "y"), ("l", None)]


def test_embedding_batches(spark):
    seen = spark.sparkContext.accumulator(0)
    chunks = spark.createDataFrame([(str(i), f"t{i % 7}") for i in range(30)], "id string, content string")

    def fn(texts):
        assert len(texts) <= 3
        seen.add(len(texts))
        return hashed_words(texts)

    out = {r.chunk_id: r.embedding for r in embed_chunks(chunks, fn, 3, parallel=2).collect()}
    assert len(out) == 30 and seen.value == 7
    assert np.allclose(out["3"], hashed_words(["t3"])[0]) and hashed_words([""])[0] == [0.0] * 64


def test_search(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 8)).astype(np.float32)
    x[7], x[11], x[12] = 0, x[3], x[3]
    rows = [(f"c{i:02d}", v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame([*rows, ("orphan", x[3].tolist())], "chunk_id string, embedding array<float>").repartition(3)
    chunks = spark.createDataFrame([(i, "f", 0, 1) for i, _ in rows], "id string, file_path string, start_line int, end_line int")
    one = [(t.chunk_id, t.distance) for t in search.search(chunks, vectors, x[3].tolist(), 100).collect()]
    assert [c for c, _ in one[:3]] == ["c03", "c11", "c12"] and one[-1] == ("c07", None) and len(one) == 60
    queries = spark.createDataFrame([(i, v) for i, v in rows[:9] if i != "c07"], "query_id string, embedding array<float>")
    many = sorted(tuple(t) for t in search.search_batch(chunks, vectors, queries, 60).collect())
    assert [(t[2], t[6] and round(t[6], 9)) for t in many if t[0] == "c03"] == [(c, d and round(d, 9)) for c, d in one]
    lists = search.build_ann(vectors.where("chunk_id <> 'c07'"), 4)
    full = sorted(tuple(t) for t in search.search_ann(lists, chunks, queries, 5, 4).collect())
    assert [t[:3] for t in full] == [t[:3] for t in many if t[1] <= 5]
    few = search.search_ann(lists, chunks, queries, 5, 1).collect()
    assert 0 < len(few) <= 40 and {t.chunk_id for t in few if t["rank"] == 1} >= {"c00", "c03"}


def test_text_queries_and_ranges(spark):
    c = spark.createDataFrame([("b__0", "b", 0, 1, "# filePath: b\n---\n50% o'x"), ("a__1", "a", 5, 6, "a_b"), ("a__0", "a", 0, 4, "aXb 50x")], "id string, file_path string, start_line int, end_line int, content string")
    lines = lambda df: [(r.file_path, r.start_line) for r in df.collect()]
    assert lines(lexical.grep(c, "")) == [("a", 0), ("a", 5), ("b", 0)] and lines(lexical.grep(c, "", 2)) == [("a", 0), ("a", 5)]
    assert lines(lexical.grep(c, "a_b")) == [("a", 5)] and lines(lexical.grep_like(c, "a_b")) == [("a", 0), ("a", 5)]
    assert lines(lexical.grep(c, "o'x")) == [("b", 0)] and lines(lexical.grep(c, "filePath: b")) == [("b", 0)] and lines(lexical.grep(c, "50%")) == [("b", 0)]
    assert [r.file_path for r in lexical.glob(c, "[a]").collect()] == ["a"]
    hits = spark.createDataFrame([("a", 0, 3, 4), ("a", 3, 5, 2), ("a", 6, 7, 3), ("a", 1, 2, 9), ("b", 9, 9, 1), ("b", 2, 4, 8)], "file_path string, start_line int, end_line int, rank int")
    assert {(r.file_path, r.ranges, r.first_rank) for r in ranges.compact_ranges(hits).collect()} == {("a", "0-5, 6-7", 2), ("b", "2-4, 9-9", 1)}


def test_each_text_is_embedded_once_a_run(spark, tmp_path):
    """Writing an index embeds each distinct chunk once, and the run's own tables go when it is released."""
    import os

    seen = spark.sparkContext.accumulator(0)

    def fn(texts):
        seen.add(len(texts))
        return hashed_words(texts)

    texts = {f"p{i}": f"line one of {i}\n\nline two of {i}" for i in range(12)}
    made = index_batch(files(spark, texts), empty_index(spark), Params(target=3, most=9, embed_fn=fn), now())
    write_index(made, str(tmp_path), "p")
    chunks = read_index(spark, str(tmp_path), "p").chunks.select("content").distinct().count()
    assert seen.value == chunks == 24
    held = made.held.removeprefix("file:")
    assert os.path.isdir(held)
    made.release()
    assert not os.path.exists(held)


def test_few_lists_find_most(spark):
    """Recall at three of eight lists on clustered vectors, against the exact search; and only probed lists are read."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(8, 16))
    x = np.concatenate([c + 0.35 * r.normal(size=(60, 16)) for c in centres]).astype(np.float32)
    rows = [(f"c{i:03d}", v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(3)
    chunks = spark.createDataFrame([(i, "f", 0, 1) for i, _ in rows], "id string, file_path string, start_line int, end_line int")
    queries = spark.createDataFrame(rows[::16], "query_id string, embedding array<float>")
    lists = search.build_ann(vectors, 8)
    found = lambda df: {(t.query_id, t.chunk_id) for t in df.collect()}
    exact = found(search.search_batch(chunks, vectors, queries, 10))
    assert len(exact & found(search.search_ann(lists, chunks, queries, 10, 3))) >= 0.95 * len(exact)
    assert found(search.search_ann(lists, chunks, queries, 10, 8)) == exact
    plan = search._probed(lists, np.array([[3]]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert "embedding" not in plan.split("ReadSchema")[1]


def test_one_row_a_query_and_place_leaves_a_task(spark):
    """Whatever the rows a task reads, k rows a query leave it."""
    r = np.random.default_rng(8)
    batches = [__import__("pyarrow").RecordBatch.from_pydict({"chunk_id": [f"r{b}_{i}" for i in range(50)], "embedding": r.normal(size=(50, 4)).tolist()}) for b in range(5)]
    out = list(search._nearest(iter(batches), ["q", "s"], r.normal(size=(2, 4)), 3))
    assert len(out) == 1 and out[0].num_rows == 6


def test_programs_fold_small(spark):
    """Node tables of the three languages through the whole chunker: a small budget splits class and import."""
    from quillspan.operators.chunk import chunk_files
    from quillspan.plans import views as V

    text = "import a from 'b'; class C1 { m2() { return 1 } }"
    spec = V.PROGRAMS["en"]
    at = lambda e: eval(e.replace("A", "2").replace("B", "2"))  # noqa: E731, S307
    nodes = spark.createDataFrame([("a.ts", k, p, f, t, at(i), at(j), 0, 0, n) for k, p, f, t, i, j, n in spec[3]], "file_path string, node_id int, parent_id int, field string, type string, start int, end int, start_row int, end_row int, child_count int")
    assert at(spec[3][0][5]) == len(text) and all(text[at(i) : at(j)] == want for (_, _, _, t, i, j, _), want in zip(spec[3], [text, "import a from 'b';", text[19:], "C1", "{", "m2() { return 1 }", "m2", "{ return 1 }", "}"], strict=True))
    got = chunk_files(spark.createDataFrame([("a.ts", text, "typescript")], "file_path string, content string, language string"), 5, 6, nodes).collect()
    assert len(got) == 2 and "#   - C1 -> m2\n" in got[1].content and got[1].content.endswith("} }")


def _bytes(folder):
    import pathlib

    return {str(p.parent.relative_to(folder)): sum(f.stat().st_size for f in p.parent.glob("*.parquet")) for p in pathlib.Path(folder).rglob("*.parquet")}


def test_codes_bounds_and_balanced_lists(spark, tmp_path):
    """Codes are a quarter of the vectors' bytes, their bounds hold, no part is beyond twice the mean, and all lists give the exact result, zero vectors and copies included."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(400, 128)), 3 + 0.1 * r.normal(size=(500, 128)), np.repeat(r.normal(size=(1, 128)), 300, axis=0), np.zeros((30, 128))]).astype(np.float32)
    x = x[r.permutation(len(x))]
    rows = [(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(3)
    chunks = spark.createDataFrame([(i, "f", 0, 1) for i, _ in rows if i != "v0007"], "id string, file_path string, start_line int, end_line int")
    lists = search.build_ann(vectors, 10, path=f"{tmp_path}/lists")
    code, step, off = search.codes_of(x.astype(float))
    unit = x / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    assert (np.linalg.norm(unit - code * step[:, None].astype(float), axis=1) <= off).all() and off.max() < 0.05
    parts = [t["count"] for t in lists.codes.groupBy("list", "shard").count().collect()]
    assert sum(parts) == len(rows) and max(parts) <= 2 * len(rows) / 10 and len(lists.centres) > 10
    assert sum(_bytes(f"{tmp_path}/lists/codes").values()) < 0.4 * sum(_bytes(f"{tmp_path}/lists/vectors").values())
    queries = spark.createDataFrame([*rows[:25], ("zero", [0.0] * 128)], "query_id string, embedding array<float>")
    pick = lambda df: sorted((t.query_id, t["rank"], t.chunk_id, t.distance and round(t.distance, 9)) for t in df.collect())
    exact = pick(search.search_batch(chunks, vectors, queries, 8))
    again = search.load_ann(spark, f"{tmp_path}/lists")
    assert len(exact) == 26 * 8 and pick(search.search_ann(again, chunks, queries, 8, len(again.centres))) == exact


def test_recall_on_the_embeddings(spark):
    """Two thirds of the lists find nine of ten of the nearest, on vectors that have little structure."""
    from quillspan.plans import views as V

    sf = "/root/testdata/sf0.01"
    chunks, vectors = V.vector_chunks(spark, sf), V.vectors(spark, sf)
    queries = vectors.where("cast(chunk_id as int) % 10 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    lists = search.build_ann(vectors, 12)
    found = lambda df: {(t.query_id, t.chunk_id) for t in df.collect()}
    exact = found(search.search_batch(chunks, vectors, queries, 10))
    assert len(exact) == 500 and len(exact & found(search.search_ann(lists, chunks, queries, 10, 8))) >= 450


def test_orphans_do_not_take_places(spark):
    """More orphans than spare places, nearer than all chunks: every search still gives k chunks."""
    r = np.random.default_rng(4)
    base = r.normal(size=8)
    rows = [(f"o{i:03d}", base.tolist()) for i in range(120)] + [(f"c{i}", (base + 0.1 * (i + 1) * r.normal(size=8)).tolist()) for i in range(9)]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(3)
    chunks = spark.createDataFrame([(i, "f", 0, 1) for i, _ in rows if i[0] == "c"], "id string, file_path string, start_line int, end_line int")
    queries = spark.createDataFrame([("q", base.tolist()), ("r", (-base).tolist())], "query_id string, embedding array<float>")
    near = [t.chunk_id for t in search.search(chunks, vectors, base.tolist(), 4).collect()]
    many = {(t.query_id, t["rank"]): t.chunk_id for t in search.search_batch(chunks, vectors, queries, 4).collect()}
    assert [many[("q", n)] for n in range(1, 5)] == near and len(many) == 8
    lists = search.build_ann(vectors, 2)
    assert {(t.query_id, t["rank"]): t.chunk_id for t in search.search_ann(lists, chunks, queries, 4, len(lists.centres)).collect()} == many
    assert len(search.search(chunks, vectors, base.tolist(), 100).collect()) == 9


def test_no_vector_is_shuffled(spark):
    """What a search of many queries moves are ids and distances."""
    from quillspan.plans import views as V

    sf = "/root/testdata/sf0.001"
    rows = V.vectors(spark, sf).select("chunk_id", "embedding")
    ids, vectors = next(search._blocks(V.vector_queries(spark, sf)))
    plan = search._ranked(rows.mapInArrow(lambda b: search._nearest(b, ids, vectors, 5), search.FOUND), 5)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.split("MapInArrow")[0]


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id string, embedding array<float>")
    chunks = spark.createDataFrame([("a", "f", 0, 1)], "id string, file_path string, start_line int, end_line int")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert search.search(chunks, none, [1.0, 0.0]).collect() == [] and search.search_batch(chunks, none, queries).collect() == []
    assert search.search_batch(chunks, none, queries.limit(0)).collect() == []
    assert search.search_ann(search.build_ann(none), chunks, queries).collect() == []
