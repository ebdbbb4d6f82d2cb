"""Numpy kernels over batches of texts, and the small Spark helpers the operators share.

Texts are handled as UTF-8 bytes: every character that separates words here is
ASCII, so no multi-byte character is ever split. Work goes through pieces of a
half a MB (`pieces`), so that the arrays of a batch stay small whatever its rows
hold; one longer text is a piece of its own. `tidy` gives a task's memory back when
it ends, since the worker lives on.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Rows and bytes up to which a table is sent to every executor; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (shifts and odd multipliers), so that every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_POWER = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        _POWER = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n, 256) - 1, _STEP | np.uint64(3)))])
    return _POWER


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Exclusive running sum."""
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out


def pieces(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about `most` bytes at most."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what a task makes of one stays small; slices share the batch's memory."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def tidy(run: Callable) -> Callable:
    """The function over batches, after whose last batch freed memory goes back to the system: workers are reused, and idle ones would keep it."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Freed memory goes back to the system; glibc has a call of its own for that."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Words:
    """The words (runs without ASCII white space) of some texts.

    `starts`, `ends`: byte ranges in `buf`; `counts`: words per text; `first`:
    index of each text's first word; `hashes`: one 64-bit value per word.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        solid = ~_SPACE[self.buf]
        edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        self.starts, self.ends = edge[::2], edge[1::2]
        at = starts_of(np.array([len(t) + 1 for t in texts] + [0], np.int64))
        bounds = np.searchsorted(self.starts, at)
        self.first, self.counts = bounds[:-1], np.diff(bounds)
        lengths = self.ends - self.starts
        if len(lengths):
            begin = starts_of(lengths)
            inside = np.arange(lengths.sum()) - np.repeat(begin, lengths)
            value = _BYTE[self.buf[solid]] * _powers(int(lengths.max()))[inside]
            self.hashes = mix(np.add.reduceat(value, begin) + lengths.astype(np.uint64) * _STEP)
        else:
            self.hashes = np.zeros(0, np.uint64)


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit value for each k consecutive words, at the first one's index."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64) * _STEP
    for j in range(k):
        out = (out + hashes[j : j + n]) * (_STEP + np.uint64(2 * j))
    return mix(out)


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct values of the k-word shingles of each text; of the whole text if it has fewer words."""
    words = Words(texts, lower=True)
    all_runs, out = runs_of(words.hashes, k), []
    for f, c in zip(words.first.tolist(), words.counts.tolist(), strict=True):
        if c >= k:
            out.append(np.unique(all_runs[f : f + c - k + 1]))
        else:
            out.append(runs_of(words.hashes[f : f + c], c) if c else np.zeros(0, np.uint64))
    return out


#: Rows that go to a Python worker at once, where queries ask for it.
ARROW_ROWS = 1024


def for_long_texts(spark: SparkSession) -> None:
    """Sets this session to hand Python workers at most `ARROW_ROWS` rows at a time.

    Spark's 10,000 rows a batch of long texts would be held several times, in the
    executor and in each of its workers. The registered queries and the pipeline's
    stages call this; operators leave the session as it is, and no result depends
    on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own in local mode; on a cluster that is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-quillspan-"))
    return spark.sparkContext.getCheckpointDir()


def let_go(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage: Spark deletes the shuffle files of steps that nothing refers to any more only then. For jobs that shuffle much in several steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quillspan-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes_of(name: str, kind: DataType) -> str:
    """SQL for about how many bytes a column's value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return f"coalesce(octet_length({name}), 0) + 16"
    if isinstance(kind, StructType):
        return " + ".join(["8", *(_bytes_of(f"{name}.`{f.name}`", f.dataType) for f in kind)])
    if isinstance(kind, ArrayType) and not isinstance(kind.elementType, (StringType, BinaryType, ArrayType, MapType, StructType)):
        return f"16 + 8 * coalesce(size({name}), 0)"
    if isinstance(kind, (ArrayType, MapType)):
        return f"coalesce(octet_length(to_json({name})), 0) + 16"
    return "8"


def sized(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows and bytes, both counted, are within the bounds above, else as it is."""
    row = " + ".join(["16", *(_bytes_of(f"`{f.name}`", f.dataType) for f in df.schema)])
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.expr(f"cast({row} as bigint)")), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The rows with the n smallest values of a column, ties and all. Only those values meet in one task, not the rows."""
    cut = df.select(order).distinct().orderBy(order).limit(n).agg(F.max(order)).first()[0]
    return df.where(F.lit(False) if cut is None else F.col(order) <= cut)


def connected(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable from each id by links (a, b).

    Alternates large-star and small-star steps until the edges no longer
    change; each step is an aggregation and a join, so no group is gathered.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u <> v").distinct().toDF("a", "b"))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
