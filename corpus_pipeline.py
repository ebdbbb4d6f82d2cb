"""A corpus pipeline of five stages over `documents`.

Language identification drops what has no language; the Jaccard join keeps one
row of each class of near copies; the secret scan blanks secrets out; mixing
takes the sources to their target weights, which may repeat a document; packing
lays the rest out in sequences. Each stage reads what the one before it wrote.

Null and empty texts are dropped by the first stage, so the others see none in
run(); by itself each takes them as its operator does. Very long texts go through
whole. Repeated rows and repeated or null ids are rows of their own until the
second stage, which keeps one row of a class; classes tie by id, then by text.
Columns beside those of documents are kept up to the fourth stage, whatever their
names. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import jaccard_join, language_id, mixing, packing, secret_scan
from quillspan.llm.arrays import for_long_texts, shared_dir, sized, table, written


def _aside(docs: DataFrame) -> DataFrame:
    """docs with the columns that are not those of documents under names that no operator gives, in the same order."""
    own = ("doc_id", "text", "lang", "source", "n_chars")
    return docs.toDF(*[c if c in own else f"__kept{i}" for i, c in enumerate(docs.columns)])


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is null or has no letters (`und`)."""
    for_long_texts(spark)
    aside = _aside(docs)
    found = language_id.identified(aside, language_id.train(docs))
    return found.where("lang_pred <> 'und'").select(aside.columns).toDF(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: of its smallest id (null last), then set digest, text and other columns. Rows without words are all kept."""
    for_long_texts(spark)
    classes = jaccard_join.near_copies(docs).where("root is not null").groupBy("root", "doc_id", "sid", "text_id").count()
    classes = written(classes)
    best = F.min(F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "sid", "text_id", "count")).alias("best")
    firsts = written(classes.groupBy("root").agg(best, F.sum("count").alias("rows")).where("rows > 1").select("root", "best"))
    rest = classes.join(sized(firsts), "root").where("not (doc_id <=> best.doc_id and text_id = best.text_id)")
    drop = written(rest.select(F.col("doc_id").alias("__d"), F.col("text_id").alias("__x")))
    twice = written(firsts.where("best.count > 1").select(F.col("best.doc_id").alias("__d"), F.col("best.text_id").alias("__x")))
    docs_by = docs.withColumn("__t", F.xxhash64("text"))
    same = F.expr("__t = __x and doc_id <=> __d")
    kept = docs_by.join(sized(drop), same, "left_anti")
    if twice.isEmpty():
        return kept.select(docs.columns)
    again = kept.join(sized(twice), same, "left_semi").groupBy("doc_id", "__t").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return kept.join(sized(twice), same, "left_anti").select(docs.columns).unionByName(again.select("row.*"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by a mark."""
    for_long_texts(spark)
    return secret_scan.redacted(docs).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix holds it (0 to 3 times)."""
    for_long_texts(spark)
    aside = _aside(docs)
    mixed = mixing.mixed(aside).where("mix_copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(aside.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in the sequences; a repeated document is packed as often as it is there."""
    for_long_texts(spark)
    return packing.packed(docs)


STAGES = [("language ID", identify), ("n-gram Jaccard join", one_of_each), ("secret scan", blank_secrets), ("mixing", mix), ("packing", pack)]

#: Learned models, hashes and packing have no SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
