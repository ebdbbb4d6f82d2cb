"""Compaction of hits into line ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compact_ranges(hits: DataFrame) -> DataFrame:
    """(file_path, ranges[, first_rank]) of hits(file_path, start_line, end_line[, rank]).

    Ranges are united where a start is at most the running end; `s-e` by start,
    joined by a comma and a space.
    """
    order = Window.partitionBy("file_path").orderBy("start_line", "end_line")
    before = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col("start_line") > before)).cast("int")
    island = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = [F.min("rank").alias("rank")] if "rank" in hits.columns else []
    united = hits.withColumn("opens", opens).withColumn("island", island).groupBy("file_path", "island").agg(F.min("start_line").alias("s"), F.max("end_line").alias("e"), *rank)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "e"))), lambda r: F.concat(r.s.cast("string"), F.lit("-"), r.e.cast("string"))), ", ")
    return united.groupBy("file_path").agg(text.alias("ranges"), *([F.min("rank").alias("first_rank")] if rank else []))
