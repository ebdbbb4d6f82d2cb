"""Text search over chunk contents (headers included) and globbing over indexed paths.

Search without an index reads all contents. A text index keeps chunks in parts of
about equal size, by path, and for each part a filter of the runs of three bytes in
its contents; a pattern's own runs then tell which parts may have it, and only
those are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.globs import literal_prefix, matches
from quillspan.sources.store import scratch_dir

#: Bytes of contents of a part, bits of its filter (a power of two), and runs of a pattern that are asked for.
PART_BYTES, FILTER_BITS, MOST_RUNS = 16 << 20, 1 << 18, 64

_PARTED = "id string, file_path string, start_line int, end_line int, content string, part int"


def _hits(chunks: DataFrame, hit: Column, limit: int) -> DataFrame:
    found = chunks.where(hit).orderBy("file_path", "start_line", "id").limit(limit)
    return found.select("file_path", "start_line", "end_line", "content")


def grep(chunks: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """Chunks whose content has the pattern literally; an empty pattern matches all. The first by path and line."""
    return _hits(chunks, F.contains(F.col("content"), F.lit(pattern)), limit)


def grep_like(chunks: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """As grep, but `%` and `_` in the pattern are wildcards."""
    return _hits(chunks, F.col("content").like(f"%{pattern}%"), limit)


@dataclass
class TextIndex:
    """Chunks by part (`part` is a folder each), and the parts' filters as words of 64 bits."""

    chunks: DataFrame
    filters: DataFrame
    bits: int


def runs_of(text: bytes, bits: int) -> np.ndarray:
    """The filter's places of a text's runs of three bytes."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    value = (raw[:-2] | raw[1:-1] << np.uint64(8) | raw[2:] << np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((value >> np.uint64(40)).astype(np.int64) & (bits - 1))


def build_text_index(chunks: DataFrame, path: str | None = None, part_bytes: int = PART_BYTES, bits: int = FILTER_BITS) -> TextIndex:
    """Writes chunks(id, file_path, start_line, end_line, content) by parts and their filters to a folder, one of its own without path."""
    spark, path = chunks.sparkSession, path or scratch_dir(chunks.sparkSession)
    rows = chunks.select("id", "file_path", "start_line", "end_line", "content")
    total = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-total // part_bytes)), "file_path", "start_line", "id").withColumn("part", F.spark_partition_id())
    dealt.sortWithinPartitions("part", "file_path", "start_line", "id").write.partitionBy("part").parquet(f"{path}/chunks")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, np.zeros(bits, bool)
        for b in batches:
            for k, content in zip(b.column("part").to_pylist(), b.column("content").cast(pa.binary()).to_pylist(), strict=True):
                if k != part:
                    yield told(part, held)
                    part, held = k, np.zeros(bits, bool)
                held[runs_of(content or b"", bits)] = True
        yield told(part, held)

    def told(part: int | None, held: np.ndarray) -> pa.RecordBatch:
        words = np.packbits(held, bitorder="little").view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([part][: part is not None], pa.int32()), pa.array([words][: part is not None], pa.list_(pa.int64()))], names=["part", "words"])

    # A part's files may be read by several tasks: each gives what it has seen, and a reader takes them together.
    read = spark.read.schema(_PARTED).parquet(f"{path}/chunks").select("part", "content")
    read.sortWithinPartitions("part").mapInArrow(gather, "part int, words array<long>").write.parquet(f"{path}/filters-{bits}")
    return load_text_index(spark, path, bits)


def load_text_index(spark: SparkSession, path: str, bits: int = FILTER_BITS) -> TextIndex:
    return TextIndex(spark.read.schema(_PARTED).parquet(f"{path}/chunks"), spark.read.schema("part int, words array<long>").parquet(f"{path}/filters-{bits}"), bits)


def parts_with(index: TextIndex, literals: list[str]) -> list[int] | None:
    """The parts that may have all literals; None (all) where none of them has three bytes."""
    places = sorted({int(p) for x in literals for p in runs_of(x.encode(), index.bits)})[:MOST_RUNS]
    if not places:
        return None
    has = [F.max(F.getbit(F.element_at("words", p // 64 + 1), F.lit(p % 64))).alias(f"p{p}") for p in places]
    seen = index.filters.groupBy("part").agg(*has).where(reduce(lambda a, b: a & b, [F.col(f"p{p}") == 1 for p in places]))
    return sorted(r["part"] for r in seen.select("part").collect())


def _parts(index: TextIndex, literals: list[str]) -> DataFrame:
    parts = parts_with(index, literals)
    return index.chunks if parts is None else index.chunks.where(F.col("part").isin(parts) if parts else F.lit(False))


def grep_indexed(index: TextIndex, pattern: str, limit: int = 100) -> DataFrame:
    """As grep, reading only parts that may have the pattern; patterns of fewer than three bytes read all."""
    return grep(_parts(index, [pattern]), pattern, limit)


def like_literals(pattern: str) -> list[str]:
    """What a LIKE pattern needs literally: the texts between its wildcards, a backslash making the next character one of them."""
    out, i = [""], 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            i += 1
            out[-1] += pattern[i]
        elif pattern[i] in "%_":
            out.append("")
        else:
            out[-1] += pattern[i]
        i += 1
    return [x for x in out if x]


def grep_like_indexed(index: TextIndex, pattern: str, limit: int = 100) -> DataFrame:
    """As grep_like, reading only parts that may have what the pattern needs literally."""
    return grep_like(_parts(index, like_literals(pattern)), pattern, limit)


def glob(documents: DataFrame, pattern: str) -> DataFrame:
    """The distinct indexed paths that match. The pattern's literal beginning reaches the scan, which skips row groups of other paths where they are sorted."""
    path = F.col("file_path")
    found = documents.select("file_path").where(matches(path, [pattern]))
    begin = literal_prefix(pattern)
    return (found.where(path.startswith(begin)) if begin else found).distinct()
