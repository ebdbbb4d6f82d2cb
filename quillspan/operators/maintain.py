"""Index maintenance: deletes, inserts with keys, and what is still to embed.

Spark has no keys, so inserts check them: a repeated key raises when the rows
are read. Paths to delete are joined as they are; Spark sends a small table to
the executors and shuffles a large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import check_dimensions


def remove_documents(documents: DataFrame, paths: DataFrame) -> DataFrame:
    return documents.join(paths.select("file_path").distinct(), "file_path", "left_anti").select(documents.columns)


def remove_chunks(chunks: DataFrame, embeddings: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, embeddings) without those of the paths."""
    paths = paths.select("file_path").distinct()
    gone = chunks.join(paths, "file_path", "left_semi").select(F.col("id").alias("chunk_id"))
    return chunks.join(paths, "file_path", "left_anti").select(chunks.columns), embeddings.join(gone, "chunk_id", "left_anti").select(embeddings.columns)


def insert_documents(documents: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Adds new(file_path, hash), stamped; a path that is there stays as it is, and of equal new paths one is taken."""
    added = new.groupBy("file_path").agg(F.min("hash").alias("hash")).join(documents.select("file_path"), "file_path", "left_anti")
    return documents.unionByName(added.select("file_path", "hash", now.alias("created_at"), now.alias("updated_at")))


def _keyed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, raising for a key that it repeats or that old has."""
    known = old.select(key, F.lit(True).alias("__old")).distinct()
    times = new.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    bad = (F.col("__n") > 1) | F.col("__old").isNotNull()
    said = F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key)))
    checked = new.join(times, key).join(known, key, "left")
    return checked.withColumn(key, F.when(bad, said.cast("string")).otherwise(F.col(key))).select(new.columns)


def insert_chunks(chunks: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    return chunks.unionByName(_keyed(chunks, new, "id").withColumn("created_at", now).select(chunks.columns))


def insert_embeddings(embeddings: DataFrame, new: DataFrame, now: Column, width: int | None = None) -> DataFrame:
    new = check_dimensions(new, width) if width else new
    return embeddings.unionByName(_keyed(embeddings, new, "chunk_id").withColumn("created_at", now).select(embeddings.columns))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Per key the row with the greatest order, by a hash aggregate."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def pending_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, content) of the chunks without a vector."""
    return chunks.join(embeddings.select(F.col("chunk_id").alias("id")), "id", "left_anti").select("id", "content")


def get_documents(documents: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The rows of the paths, all without; a missing path raises when it is read, naming it."""
    if paths is None:
        return documents
    found = paths.select("file_path").distinct().join(documents.withColumn("__found", F.lit(True)), "file_path", "left")
    missing = F.raise_error(F.concat(F.lit("no such document: "), F.col("file_path")))
    return found.withColumn("file_path", F.when(F.col("__found").isNull(), missing.cast("string")).otherwise(F.col("file_path"))).select(documents.columns)


