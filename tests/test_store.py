import itertools
import os
import threading

import pytest
from pyspark.sql import functions as F

from quillspan.functions.text import content_hash
from quillspan.operators import lexical
from quillspan.operators.embed import hashed_words
from quillspan.operators.index import Params, index_batch
from quillspan.sources import store
from quillspan.sources.store import Conflict, VectorStore, bucket_of, empty_index, expire_versions, read_index, retrying, stored_bytes, write_index
from quillspan.streaming.index_stream import apply_batch

STREAM = "file_path string, content string, language string, arrived int"


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def files(spark, texts):
    df = spark.createDataFrame([(p, t, "text") for p, t in texts.items()], "file_path string, content string, language string")
    return df.withColumn("hash", content_hash(F.col("content")))


def contents(index):
    chunks = sorted((r.id, r.content.split("---\n")[1]) for r in index.chunks.collect())
    assert sorted(r.chunk_id for r in index.embeddings.collect()) == [i for i, _ in chunks]
    assert sorted(r.file_path for r in index.documents.collect()) == sorted({i.rsplit("__", 1)[0] for i, _ in chunks})
    return chunks


@pytest.fixture
def texts():
    return {f"d{i % 7}/p{i}": f"text number {i}" for i in range(60)}


@pytest.fixture
def stored(spark, tmp_path, texts):
    made = index_batch(files(spark, texts), empty_index(spark), None, now())
    assert write_index(made, str(tmp_path), "p", 16) == 1
    return str(tmp_path)


def test_bytes_written_follow_the_change(spark, stored, texts):
    before = dict(stored_bytes(spark, stored, "p"))
    changed = texts | {"d0/p0": "another text"}
    after = index_batch(files(spark, changed), read_index(spark, stored, "p"), None, now())
    assert after.counts == {"new": 0, "modified": 1, "unchanged": 59, "deleted": 0}
    assert contents(after)[0] == ("d0/p0__0", "another text")
    assert write_index(after, stored, "p") == 2
    parts = dict(stored_bytes(spark, stored, "p"))
    new = set(parts) - set(before)
    assert len(new) == 3 and sum(parts[p] for p in new) < 0.3 * sum(parts.values())  # one bucket of three tables
    assert contents(read_index(spark, stored, "p")) == contents(index_batch(files(spark, changed), empty_index(spark), None, now()))
    nothing = index_batch(files(spark, changed), read_index(spark, stored, "p"), None, now())
    assert write_index(nothing, stored, "p") == 2 and nothing.counts["unchanged"] == 60


def test_a_deleted_file_empties_its_bucket(spark, tmp_path):
    made = index_batch(files(spark, {"a": "x", "b": "y"}), empty_index(spark), None, now())
    write_index(made, str(tmp_path), "p", 64)
    write_index(index_batch(files(spark, {"a": "x"}), read_index(spark, str(tmp_path), "p"), None, now()), str(tmp_path), "p")
    assert contents(read_index(spark, str(tmp_path), "p")) == [("a__0", "x")]


def test_two_writers_lose_nothing(spark, stored, texts):
    """Runs that begin at one version: of other buckets, both count; of the same, the second is refused and may be repeated."""
    of = {r.p: r.b for r in spark.createDataFrame([(p,) for p in texts], "p string").select("p", bucket_of(F.col("p"), 16).alias("b")).collect()}
    one = "d0/p0"
    other = next(p for p in texts if of[p] != of[one])
    same = next((p for p in texts if of[p] == of[one] and p != one), one)
    runs = [index_batch(files(spark, {p: f"new {p}"}), read_index(spark, stored, "p"), None, now(), partial=True) for p in (one, other, same)]
    assert write_index(runs[0], stored, "p") == 2 and write_index(runs[1], stored, "p") == 3
    with pytest.raises(Conflict, match="same buckets"):
        write_index(runs[2], stored, "p")
    again = retrying(spark, stored, "p", lambda index: index_batch(files(spark, {same: f"new {same}"}), index, None, now(), partial=True))
    assert again == 4
    got = dict(contents(read_index(spark, stored, "p")))
    assert {got[f"{p}__0"] for p in (one, other, same)} == {f"new {p}" for p in (one, other, same)} and len(got) == 60
    with pytest.raises(Conflict):  # all buckets, from a version that is not the newest
        stale = empty_index(spark)
        stale.base = store.Manifest(1, 16)
        write_index(stale, stored, "p")


def test_writers_at_the_same_time(spark, stored, texts):
    """Each thread changes files of its own; conflicts are repeated, and in the end all changes are there."""
    paths, failed = list(texts)[:3], []

    def change(p):
        try:
            retrying(spark, stored, "p", lambda index: index_batch(files(spark, {p: f"by thread {p}"}), index, None, now(), partial=True), 20)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=change, args=(p,)) for p in paths]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = dict(contents(read_index(spark, stored, "p")))
    assert [got[f"{p}__0"] for p in paths] == [f"by thread {p}" for p in paths] and len(got) == 60
    assert store.versions(store._Files(spark, f"{stored}/p")) == [1, 2, 3, 4]


def test_a_version_that_is_never_completed(spark, stored, monkeypatch):
    monkeypatch.setattr(store, "PATIENCE_S", 0.3)
    with open(f"{stored}/p/versions/v2.json", "w") as f:
        f.write('{"buckets": 16, "par')
    assert read_index(spark, stored, "p").base.version == 1
    assert write_index(index_batch(files(spark, {"z": "new"}), read_index(spark, stored, "p"), None, now(), partial=True), stored, "p") == 2


def test_expired_versions_take_their_parts(spark, stored, texts):
    for n in range(3):
        write_index(index_batch(files(spark, {"d0/p0": f"turn {n}"}), read_index(spark, stored, "p"), None, now(), partial=True), stored, "p")
    want = contents(read_index(spark, stored, "p"))
    gone = expire_versions(spark, stored, "p", keep=1)
    assert len(gone) == 9 and not any(os.path.exists(f"{stored}/p/{g}") for g in gone)
    assert contents(read_index(spark, stored, "p")) == want and expire_versions(spark, stored, "p", keep=1) == []


def test_older_versions_that_come_late(spark, tmp_path):
    """Whatever the order of batches, what is indexed is the newest version of each path; a path without chunks remembers too."""
    batches = [[("a", "new text", "text", 9), ("b", "b one", "text", 1), ("e", "", "text", 5)], [("a", "OLD text", "text", 2), ("c", "c", "text", 4), ("e", "was text", "text", 3)], [("b", "b two", "text", 2), ("c", "tied", "text", 4), ("d", None, "text", None)]]
    rows = [r for b in batches for r in b]
    newest = {}
    for p, t, _, at in rows:
        key = (at if at is not None else -1, __import__("hashlib").sha256((t or "").encode()).hexdigest())
        newest[p] = max(newest.get(p, (key, t)), (key, t))
    want = contents(index_batch(files(spark, {p: t for p, (_, t) in newest.items()}), empty_index(spark), None, now()))
    for n, order in enumerate(itertools.permutations(batches[::-1])):
        for batch in [*order, order[0]]:  # and one that comes again
            index = apply_batch(spark.createDataFrame(batch, STREAM), read_index(spark, str(tmp_path), f"p{n}"))
            write_index(index, str(tmp_path), f"p{n}")
            index.release()
        got = read_index(spark, str(tmp_path), f"p{n}")
        assert contents(got) == want and got.base.version <= 3
        assert {r.file_path: r.arrived for r in got.arrivals.collect()} == {"a": 9, "b": 2, "c": 4, "d": -(1 << 63), "e": 5}
        if n == 1:
            break


def test_vectors_are_kept_by_content(spark, tmp_path):
    """A changed line embeds only the chunks whose text changed, in whatever file; a run that failed after it pays nothing again."""
    sent = spark.sparkContext.accumulator(0)

    def fn(texts):
        sent.add(len(texts))
        return hashed_words(texts)

    kept = VectorStore(spark, f"{tmp_path}/vectors", "m")
    p = Params(target=3, most=9, embed_fn=fn, store=kept)
    one = {"a": "\n".join(f"line {i} here" for i in range(20))}
    write_index(index_batch(files(spark, one), empty_index(spark), p, now()), str(tmp_path), "p")
    first = sent.value
    assert first == 20
    two = {"a": one["a"].replace("line 7 here", "line 7 changed")}
    index_batch(files(spark, two), read_index(spark, str(tmp_path), "p"), p, now())  # never written: as if it had failed
    assert sent.value == first + 1
    after = index_batch(files(spark, two), read_index(spark, str(tmp_path), "p"), p, now())
    assert sent.value == first + 1 and write_index(after, str(tmp_path), "p") == 2
    kept.add(kept.vectors().limit(5))  # as another run at the same time would
    got = {r.chunk_id: r.embedding for r in read_index(spark, str(tmp_path), "p").embeddings.collect()}
    want = {r.id: hashed_words([r.content])[0] for r in read_index(spark, str(tmp_path), "p").chunks.collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-6 for i in got for x, y in zip(got[i], want[i], strict=True))
    assert kept.vectors().count() == 26
    kept.compact()
    assert kept.vectors().count() == 21 and len(kept._runs()) == 1
    assert VectorStore(spark, f"{tmp_path}/vectors", "other").vectors().count() == 0


def test_glob_reaches_the_scan(spark, stored):
    documents = read_index(spark, stored, "p").documents
    found = lexical.glob(documents, "d3/p*[13579]")
    assert "StringStartsWith(file_path,d3/p)" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.file_path for r in found.collect()) == sorted(f"d3/p{i}" for i in range(60) if i % 7 == 3 and i % 2)
    assert lexical.glob(documents, "{d3,d4}/p3").count() == 1 and lexical.glob(documents, "**").count() == 60
