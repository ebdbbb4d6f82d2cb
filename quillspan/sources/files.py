"""Sources: trees of files, and the wide table of an index."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.globs import chosen_path
from quillspan.functions.text import content_hash, tag_language
from quillspan.sources.store import kept, scratch_dir

#: Bytes of files that a task of a scan reads, about; and its tasks for each core at least.
SCAN_BYTES, SCAN_TASKS = 1 << 24, 4
#: Spark's driver holds the listed files (about 1 KB each); so many at once, about.
SCAN_FILES = 100_000


def local_path(spark: SparkSession, root: str) -> str | None:
    """The path of a folder on a local file system, or on one that is mounted everywhere; None for any other."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def write_files(files: DataFrame, folder: str) -> None:
    """Writes each row of (file_path, content) as a file of its own below a folder that is a local path to all tasks.

    A file gets its name once it is whole, so tasks that run twice leave it as it is.
    """

    def run(batches):
        made, attempt = set(), uuid.uuid4().hex
        for batch in batches:
            for path, content in zip(*(batch.column(k).to_pylist() for k in ("file_path", "content")), strict=True):
                below, name = os.path.split(os.path.join(folder, path))
                if below not in made:
                    os.makedirs(below, exist_ok=True)
                    made.add(below)
                with open(part := f"{below}/.{attempt}", "wb") as f:
                    f.write(content)
                os.replace(part, f"{below}/{name}")
            yield batch.select(["file_path"]).slice(0, 0)

    rows = files.select("file_path", F.col("content").cast("binary").alias("content"))
    rows.mapInArrow(run, "file_path string").write.format("noop").mode("overwrite").save()


def _groups(spark: SparkSession, base: str) -> list[list[str]]:
    """The tree's folders and files in groups of at most SCAN_FILES files; the root alone where that holds for all.

    A folder without folders stays whole: Spark lists it once, but looks up each of many paths.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top, scheme = local_path(spark, base), "file://"
    if top is not None:

        def count(folder: str) -> int:
            return sum(len(names) for _, _, names in os.walk(folder))

        def entries(folder: str) -> list[tuple[str, bool]]:
            with os.scandir(folder) as found:
                return [(x.path, x.is_dir()) for x in found]
    else:
        top, scheme = base, ""

        def count(folder: str) -> int:
            return fs.getContentSummary(path(folder)).getFileCount()

        def entries(folder: str) -> list[tuple[str, bool]]:
            return [(x.getPath().toString(), x.isDirectory()) for x in fs.listStatus(path(folder))]

    groups, room = [[]], SCAN_FILES
    if not fs.exists(path(base)) or count(top) <= SCAN_FILES:
        return [[base]]
    folders = [top]
    while folders:
        found = entries(folder := folders.pop())
        if not any(is_folder for _, is_folder in found):
            found = [(folder, False)]
        for name, is_folder in found:
            if re.match(r"\.|_[^=]*$", name.rpartition("/")[2]):  # Spark lists none of these
                continue
            n = count(name) if is_folder else 1
            if is_folder and n > SCAN_FILES:
                folders.append(name)
                continue
            if n > room or name == folder:
                groups.append([])
                room = SCAN_FILES
            groups[-1].append(scheme + re.sub(r"([\\{}\[\]*?])", r"\\\1", name))  # Spark takes paths as patterns
            room -= SCAN_FILES if name == folder else n
    return [g for g in groups if g] or [[base]]


def scan_files(spark: SparkSession, root: str, include: list[str], exclude: list[str], extensions: dict[str, str] | None = None) -> DataFrame:
    """(file_path, content, hash, language) of the files below root that the patterns choose.

    The patterns are asked of the listed files' paths (`_metadata.file_path`), so
    that Spark plans tasks for chosen files only and opens no other. Spark counts
    megabytes for opening a file, which makes a task of a few small files; such
    tasks are put together until they read SCAN_BYTES or are few. A tree of more
    than SCAN_FILES files is read by groups of folders, each kept as a table in
    the shared folder, as the driver can't hold the paths of all.
    """
    base = root.rstrip("/")
    local = "/" + base.split(":", 1)[-1].lstrip("/")

    def below(path: Column) -> Column:
        return F.substring(F.regexp_replace(path, r"^[a-z0-9]+:/+", "/"), len(local) + 2, 1 << 30)

    def read(paths: list[str]) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
        size = int(found._jdf.queryExecution().analyzed().stats().sizeInBytes())
        tasks = max(SCAN_TASKS * spark.sparkContext.defaultParallelism, -(-size // SCAN_BYTES))
        listed = found.where(chosen_path(below(F.col("_metadata.file_path")), include, exclude)).coalesce(tasks)
        chosen = tag_language(listed.withColumn("file_path", below(F.col("path"))), "file_path", extensions)
        text = chosen.select("file_path", F.decode("content", "UTF-8").alias("content"), "language")
        return text.select("file_path", "content", content_hash(F.col("content")).alias("hash"), "language")

    groups = _groups(spark, base)
    if len(groups) == 1:
        return read(groups[0])
    folder = scratch_dir(spark)
    tables = [kept(read(paths), f"{folder}/group={k}") for k, paths in enumerate(groups)]
    return spark.read.schema(tables[0].schema).parquet(*(f"{folder}/group={k}" for k in range(len(groups))))


def wide_index(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row per embedded chunk with its file hash and vector; a vector without chunk or document raises."""
    d = documents.select("file_path", F.col("hash").alias("file_hash"))
    joined = embeddings.select("chunk_id", "embedding").join(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id", "left").join(d, "file_path", "left")
    lost = F.raise_error(F.concat(F.lit("vector without chunk or document: "), F.col("chunk_id")))
    sure = F.when(F.col("file_hash").isNull(), lost.cast("string")).otherwise(F.col("file_hash"))
    return joined.select(F.col("chunk_id").alias("id"), "file_path", sure.alias("file_hash"), "start_line", "end_line", "content", "embedding")
