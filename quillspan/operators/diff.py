"""Snapshot diff between the files that are there and the documents that are indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("new", "modified", "unchanged", "deleted")


def diff_snapshot(files: DataFrame, documents: DataFrame) -> DataFrame:
    """(file_path, status, new_hash, old_hash); contents stay out of the join."""
    new = files.select("file_path", F.col("hash").alias("new_hash"), F.lit(True).alias("here"))
    old = documents.select("file_path", F.col("hash").alias("old_hash"), F.lit(True).alias("there"))
    status = (
        F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "deleted")
        .when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("modified")
    )
    return new.join(old, "file_path", "full").select("file_path", status.alias("status"), "new_hash", "old_hash")


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row with a count per status, zeros too."""
    return diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def files_to_clean(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("status").isin("modified", "deleted")).select("file_path")


def files_to_index(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("status").isin("new", "modified")).select("file_path")
