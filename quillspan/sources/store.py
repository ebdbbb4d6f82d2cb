"""Index tables as parts by path, named by versioned manifests; and vectors kept by the content they stand for.

A project's rows are dealt to `buckets` by a hash of their path, and a part is one
bucket of one table, sorted by path, written once and never changed. A manifest
names the parts of a version. A run writes the buckets that it touches and names
the old parts for all others, so what is written follows what changed. A version
is a file that is created only if it is not there; a writer that finds its version
taken puts its parts on top of the newer one if that touched other buckets, and
else raises `Conflict`. Readers take the newest complete manifest, so they see a
version whole or not at all.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.schemas import TABLES

#: Buckets of a new project, and how long a version that someone has begun may stay incomplete.
BUCKETS, PATIENCE_S = 32, 20.0
#: A version is taken at most so often by others before a writer gives up.
TRIES = 50


class Conflict(RuntimeError):
    """Another writer has changed the same buckets since this run has read them."""


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset, one of our own in local mode; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-quillspan-")
    return f"{base.rstrip('/')}/quillspan-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str) -> DataFrame:
    """The same rows, read from a table in the shared folder."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Files:
    """The few file system calls a store needs, on whatever file system its path is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.has(name) else []

    def has(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file was not there and has been made."""
        if self.has(name):
            return False
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception as e:
            if self.has(name):
                return False
            raise e
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass
class Manifest:
    """A version: the folders (below the project's) of each table's buckets, and what it changed of the version before."""

    version: int = 0
    buckets: int = BUCKETS
    parts: dict[str, dict[int, str]] = field(default_factory=lambda: {t: {} for t in TABLES})
    changed: dict[str, list[int]] = field(default_factory=dict)
    token: str = ""

    def text(self) -> str:
        return json.dumps({"buckets": self.buckets, "parts": self.parts, "changed": self.changed, "token": self.token, "complete": True})

    @staticmethod
    def of(version: int, text: str) -> Manifest | None:
        """None for what is not written to its end."""
        try:
            d = json.loads(text)
        except ValueError:
            return None
        return Manifest(version, d["buckets"], {t: {int(b): p for b, p in parts.items()} for t, parts in d["parts"].items()}, d["changed"], d["token"])


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def path_of(table: str) -> Column:
    """The path a row belongs to. The chunker's ids are a path, two low lines and a number."""
    return F.regexp_replace("chunk_id", "__[0-9]+$", "") if table == "embeddings" else F.col("file_path")


@dataclass
class Index:
    """The tables of one project's index: documents, chunks, vectors, and when each path's newest version arrived (streams only)."""

    documents: DataFrame
    chunks: DataFrame
    embeddings: DataFrame
    arrivals: DataFrame | None = None
    #: Folder of what a run has written for its own use, until its tables are written.
    held: str | None = None
    #: The stored version this comes from, and its folder.
    base: Manifest | None = None
    home: str | None = None
    #: What a run has changed: by table, the buckets and the rows that they now hold.
    touched: dict[str, tuple[list[int], DataFrame]] | None = None
    #: Files by status, counted while the run's diff was written.
    counts: dict[str, int] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return getattr(self, name) if getattr(self, name) is not None else self.documents.sparkSession.createDataFrame([], TABLES[name])

    def buckets(self, name: str, which: list[int] | None) -> DataFrame:
        """The rows of a stored table in some buckets, or in all; only their parts are read."""
        spark, parts = self.documents.sparkSession, self.base.parts[name]
        paths = [f"{self.home}/{parts[b]}" for b in (sorted(parts) if which is None else which) if b in parts]
        return spark.read.schema(TABLES[name]).parquet(*paths) if paths else spark.createDataFrame([], TABLES[name])

    def release(self) -> None:
        """Deletes what the run has written for itself; its tables cannot be read after that."""
        if self.held:
            _Files(self.documents.sparkSession, self.held).delete("")
            self.held = None


def empty_index(spark: SparkSession) -> Index:
    return Index(**{name: spark.createDataFrame([], schema) for name, schema in TABLES.items()})


def versions(files: _Files) -> list[int]:
    return sorted(int(n[1:-5]) for n in files.names("versions") if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())


def _newest(files: _Files) -> Manifest:
    """The newest complete version. One begun and not ended is waited for; if it stays so, its writer is dead, and it is removed."""
    until = time.monotonic() + PATIENCE_S
    while known := versions(files):
        text = files.read(f"versions/v{known[-1]}.json") if files.has(f"versions/v{known[-1]}.json") else ""
        if found := Manifest.of(known[-1], text):
            return found
        if time.monotonic() > until:
            files.delete(f"versions/v{known[-1]}.json")
        time.sleep(0.05)
    return Manifest()


def read_index(spark: SparkSession, root: str, project: str) -> Index:
    """The newest complete version; empty tables where there is none."""
    home = f"{root.rstrip('/')}/{project}"
    out = empty_index(spark)
    out.base, out.home = _newest(_Files(spark, home)), home
    for name in TABLES:
        setattr(out, name, out.buckets(name, None))
    return out


def _publish(files: _Files, base: Manifest, parts: dict[str, dict[int, str]], changed: dict[str, list[int]]) -> int:
    """Claims the next version for these parts; parts of no changed bucket stay as the newest version has them."""
    mine = {(t, b) for t, bs in changed.items() for b in bs}
    for _ in range(TRIES):
        newest = _newest(files)
        if newest.version != base.version and newest.buckets != base.buckets:
            raise Conflict("the buckets were dealt anew")
        for v in range(base.version + 1, newest.version + 1):
            between = Manifest.of(v, files.read(f"versions/v{v}.json")) if files.has(f"versions/v{v}.json") else None
            if between is None or mine & {(t, b) for t, bs in between.changed.items() for b in bs}:
                raise Conflict(f"version {v} has changed the same buckets, or is gone")
        both = {t: {**{b: p for b, p in newest.parts.get(t, {}).items() if (t, b) not in mine}, **parts.get(t, {})} for t in TABLES}
        made = Manifest(newest.version + 1, base.buckets, both, changed, uuid.uuid4().hex)
        name = f"versions/v{made.version}.json"
        if files.create(name, made.text()):
            back = Manifest.of(made.version, files.read(name)) if files.has(name) else None
            if back is None or back.token != made.token:  # this writer was thought dead, and another went on
                raise Conflict(f"version {made.version} was taken away")
            return made.version
    raise Conflict(f"others have published {TRIES} versions meanwhile")


def _written(df: DataFrame, name: str, folder: str, buckets: int) -> None:
    path = path_of(name)
    dealt = df.select(TABLES[name].fieldNames()).withColumn("bucket", bucket_of(path, buckets)).hint("rebalance", "bucket")
    # Sorted by path, so that row groups beside a path or a prefix are skipped.
    dealt.sortWithinPartitions("bucket", path).write.partitionBy("bucket").parquet(folder)


def write_index(tables: Index, root: str, project: str, buckets: int = BUCKETS) -> int:
    """Writes what a run has changed since tables.base and publishes a version that names it; returns the version.

    Tables of no stored version replace all there is. A run that has changed
    nothing publishes nothing. `buckets` counts for a new project only.
    """
    spark, home = tables.documents.sparkSession, f"{root.rstrip('/')}/{project}"
    files = _Files(spark, home)
    base = tables.base or _newest(files)
    if base.version == 0:
        base.buckets = buckets if tables.base is None else base.buckets
    todo = tables.touched
    if todo is None:
        todo = {name: (list(range(base.buckets)), tables.table(name)) for name in TABLES}
    todo = {name: (which, rows) for name, (which, rows) in todo.items() if which}
    if not todo:
        return base.version
    run, parts = f"parts/{uuid.uuid4().hex}", {}
    for name, (_, rows) in todo.items():
        _written(rows, name, f"{home}/{run}/{name}", base.buckets)
        parts[name] = {int(n.split("=")[1]): f"{run}/{name}/{n}" for n in files.names(f"{run}/{name}") if n.startswith("bucket=")}
    return _publish(files, base, parts, {name: which for name, (which, _) in todo.items()})


def retrying(spark: SparkSession, root: str, project: str, change: Callable[[Index], Index], tries: int = 5) -> int:
    """Applies a change to the newest version and writes it; on a conflict, again to the then newest one."""
    for left in range(tries - 1, -1, -1):
        after = change(read_index(spark, root, project))
        try:
            return write_index(after, root, project)
        except Conflict:
            if not left:
                raise
        finally:
            after.release()
    raise AssertionError("unreachable")


def expire_versions(spark: SparkSession, root: str, project: str, keep: int = 2) -> list[str]:
    """Deletes all but the newest versions and the parts that only they name; returns those folders. Parts of runs not yet published are named by none, and stay."""
    files = _Files(spark, f"{root.rstrip('/')}/{project}")
    _newest(files)
    known = versions(files)
    named = lambda vs: {p for v in vs for parts in Manifest.of(v, files.read(f"versions/v{v}.json")).parts.values() for p in parts.values()}
    old, live = named(known[:-keep]), named(known[-keep:])
    for v in known[:-keep]:
        files.delete(f"versions/v{v}.json")
    for folder in sorted(old - live):
        files.delete(folder)
    return sorted(old - live)


@dataclass
class VectorStore:
    """Vectors by the SHA-256 of the text they stand for, for one model; runs add to it and never change it.

    Each run adds a folder of its own, which counts once it is complete, so a run
    that fails later has still paid for its vectors once, and runs at the same time
    do not meet (a text that both embed is there twice, and read once).
    """

    spark: SparkSession
    root: str
    model: str

    @property
    def home(self) -> str:
        return f"{self.root.rstrip('/')}/model={self.model}"

    def _runs(self) -> list[str]:
        files = _Files(self.spark, self.home)
        return [f"{self.home}/{n}" for n in sorted(files.names("")) if n.startswith("run-") and files.has(f"{n}/_SUCCESS")]

    def vectors(self) -> DataFrame:
        """(h, embedding)"""
        runs = self._runs()
        schema = "h string, embedding array<float>"
        return self.spark.read.schema(schema).parquet(*runs) if runs else self.spark.createDataFrame([], schema)

    def add(self, vectors: DataFrame) -> None:
        vectors.select("h", "embedding").sortWithinPartitions("h").write.parquet(f"{self.home}/run-{uuid.uuid4().hex}")

    def compact(self) -> None:
        """Unites the runs in one, each text once."""
        old = self._runs()
        if len(old) > 1:
            self.add(self.vectors().groupBy("h").agg(F.first("embedding").alias("embedding")))
            files = _Files(self.spark, self.home)
            for run in old:
                files.delete(run.rsplit("/", 1)[1])


def stored_bytes(spark: SparkSession, root: str, project: str) -> Iterator[tuple[str, int]]:
    """(folder, bytes) of every part that the newest version names."""
    files = _Files(spark, f"{root.rstrip('/')}/{project}")
    for parts in _newest(files).parts.values():
        for folder in parts.values():
            yield folder, files.fs.getContentSummary(files._path(folder)).getLength()
