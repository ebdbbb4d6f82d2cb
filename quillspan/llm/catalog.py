"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.arrays import for_long_texts, table
from quillspan.llm.byte_bpe import encoded
from quillspan.llm.centroids import clustered, clustered_sql
from quillspan.llm.co_training import judged
from quillspan.llm.hard_negatives import hard_negatives
from quillspan.llm.html_blocks import extracted
from quillspan.llm.jaccard_join import near_copies
from quillspan.llm.language_id import languages
from quillspan.llm.mixing import mix_digest
from quillspan.llm.packing import packed
from quillspan.llm.permutation_index import search
from quillspan.llm.secret_scan import scanned
from quillspan.llm.substring_dedup import deduplicated
from quillspan.llm.webp import stored

_OP7 = """WITH RECURSIVE low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^ \\t-\\r]+') AS l FROM low),
s AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 4], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(d, k) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.k FROM r JOIN b ON b.x = r.d WHERE r.k < b.y),
m AS (SELECT d, min(k) AS k FROM r GROUP BY d)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.k AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.d = d.doc_id"""

_OP10 = """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t-\\r]+') AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(l[i:i + 12], ' ') AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) - 11)) AS i FROM w WHERE len(l) >= 13)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM m),
x AS (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS i FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(len(l), 0) AS n_words, coalesce(len(l), 0) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

_OP13 = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS BIGINT) AS s FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.p, p.ps, s.b, s.s, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.s DESC, s.b) AS k FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.ps <= 100 * s.s AND 100 * s.s <= 100 * p.ps)
SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE k <= 5"""


def _texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    for_long_texts(spark)
    return table(spark, sf_dir, name)


def op1_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_texts(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(_texts(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_texts(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_texts(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(_texts(spark, sf_dir))


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(_texts(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_texts(spark, sf_dir)).drop("n_links", "sid", "root", "text_id")


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op9_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(_texts(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(_texts(spark, sf_dir))


def op11_rotated_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings")).drop("n_looked_at")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_texts(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is moved on by one first."""
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_co_training, op2_block_labeller, op3_best_fit_packing, op4_language_id, op5_secret_scan, op6_pareto_mixing, op7_jaccard_join, op8_permutation_index, op9_lossless_webp, op10_substring_dedup, op11_rotated_centroids, op12_byte_bpe, op13_hard_negatives)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op7_jaccard_join": _OP7, "op10_substring_dedup": _OP10, "op11_rotated_centroids": clustered_sql(), "op13_hard_negatives": _OP13}
