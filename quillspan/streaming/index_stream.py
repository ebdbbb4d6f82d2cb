"""Indexing of files that arrive on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillspan.functions.text import content_hash
from quillspan.operators.index import Params, index_batch
from quillspan.operators.maintain import last_wins
from quillspan.sources.store import Index, bucket_of, kept, retrying, scratch_dir


def _as_long(df: DataFrame, column: str) -> Column:
    """An order column as a number; none is before all others."""
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(value.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        value = F.unix_date(value)
    return F.coalesce(value.cast("long"), F.lit(-(1 << 63)))


def newest_of(batch: DataFrame, order: str) -> DataFrame:
    """(file_path, content, language, hash, arrived): the last of each path's rows by order, ties by hash."""
    rows = batch.select("file_path", "content", "language", content_hash(F.col("content")).alias("hash"), _as_long(batch, order).alias("arrived"))
    return last_wins(rows.withColumn("turn", F.struct("arrived", F.coalesce("hash", F.lit("")))), "file_path", "turn").drop("turn")


def fresh_of(rows: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The rows that are later, by (arrived, hash), than what has arrived of their path before."""
    known = arrivals.select("file_path", F.struct("arrived", F.coalesce("hash", F.lit("")).alias("h")).alias("__known"))
    joined = rows.join(known, "file_path", "left")
    later = F.struct("arrived", F.coalesce("hash", F.lit("")).alias("h")) > F.col("__known")
    return joined.where(F.col("__known").isNull() | later).drop("__known")


def apply_batch(batch: DataFrame, index: Index, params: Params | None = None, order: str = "arrived") -> Index:
    """The index after a micro-batch: of each path the newest version counts, whichever batch it came in.

    When a path's newest version arrived is part of the index, also for files that
    have no chunks, and changes with it at once. A batch that comes again, or
    that is older than what is there, changes nothing.
    """
    own = scratch_dir(batch.sparkSession)
    fresh = kept(fresh_of(newest_of(batch, order), index.table("arrivals")), f"{own}/fresh")
    after = index_batch(fresh.drop("arrived"), index, params, partial=True, scratch=own)
    told = fresh.select("file_path", "arrived", "hash")
    if index.base is None:
        after.arrivals = index.table("arrivals").join(told.select("file_path"), "file_path", "left_anti").unionByName(told)
    else:
        paths = told.select(bucket_of(F.col("file_path"), index.base.buckets).alias("b")).distinct()
        which = sorted(r["b"] for r in paths.collect())
        rows = index.buckets("arrivals", which).join(told.select("file_path"), "file_path", "left_anti").unionByName(told)
        after.touched["arrivals"] = (which, rows)
    return after


def index_stream(stream: DataFrame, root: str, project: str, checkpoint: str, params: Params | None = None, order: str = "arrived") -> StreamingQuery:
    """Index stream(file_path, content, language, arrived) a micro-batch at a time, until what is there is read.

    Of a path's rows the last by `order` counts, over all batches; ties go by the
    content's hash. Documents that a batch does not name stay. Readers see a batch
    whole or not at all, and another writer's version is never lost: a batch that
    meets one is applied again to it.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        retrying(batch.sparkSession, root, project, lambda index: apply_batch(batch, index, params, order))

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
