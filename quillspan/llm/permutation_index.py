"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors (`PIVOTS` different ones of twice as
many rows, the first by a hash of vec_id). A vector is represented by the order of the pivots by nearness, and
posted in the inverted files of its `POSTED` nearest ones. A query gathers the
postings of its `PROBED` nearest pivots and ranks them by the footrule distance of
the orders. Places in an order count in `LEVELS` steps, written as bits (bit t of
a pivot tells whether its place is beyond step t), so that the footrule distance
is the number of bits that differ. Those within the query's radius, which is the
distance of its `NEAR`-th nearest in a bounded sample of `SAMPLE` vectors, are
ranked again by exact cosine. A row is a candidate of a query by the two alone:
results do not depend on how rows are dealt to tasks or batches.

The index is partitioned by rows: each task indexes the rows it reads, a block
of `BLOCK` at a time, and keeps the k best of a query; the tasks' results are
merged by a window that keeps k rows per query and task. So copies of a vector, or
many vectors near one pivot, load no task more than its own rows do. Queries are
sent out in blocks bounded by rows and bytes (`QUERIES`, `QUERY_BYTES`); a larger
query set takes several passes. Queries that have found fewer than k are answered
by an exact pass over all rows.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part. Rows with a null vec_id take no part. Rows
that repeat a vec_id are candidates each by itself, one query together (the
first by its values), and never candidates of that query. No rows, no result.
Columns beside vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.arrays import first_rows, written

PIVOTS, LEVELS, POSTED, PROBED, SAMPLE, NEAR, K = 256, 4, 12, 24, 2048, 96, 5
BLOCK, QUERIES, QUERY_BYTES = 8192, 16_384, 16 << 20


def _usable(ids: pa.Array, vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (double) that take part, by id."""
    rows = [(i, v) for i, v in zip(ids.to_pylist(), vectors.to_pylist(), strict=True) if i is not None and v and None not in v and (width is None or len(v) == width)]
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, width or 0))
    x = np.array([v for _, v in rows], float)
    i = np.array([r[0] for r in rows], np.int64)
    with np.errstate(over="ignore"):
        good = np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1) > 0)
    order = np.argsort(i[good], kind="stable")
    return i[good][order], x[good][order]


def _norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    return (top * np.sqrt(((x / top) ** 2).sum(axis=1, keepdims=True)))[:, 0]


def cosines(block: np.ndarray, norms: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (block * v).sum(axis=1) / (norms * _norms(v[None])[0])


class Permutations:
    """Orders of fixed pivots: `of` gives a row's nearest pivots in order, and its places by steps as bits."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots / _norms(pivots)[:, None]

    def of(self, x: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        near = (x / _norms(x)[:, None]) @ self.pivots.T
        order = np.argsort(-near, axis=1, kind="stable")
        n = order.shape[1]
        step = np.empty(order.shape, np.int8)
        np.put_along_axis(step, order, np.broadcast_to((np.arange(n) * LEVELS // n).astype(np.int8), order.shape), axis=1)
        bits = np.packbits(step[:, None, :] > np.arange(LEVELS - 1, dtype=np.int8)[:, None], axis=2).reshape(len(x), -1)
        return order[:, :first], np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


def footrule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows of bits."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def radii(bits: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Each row's distance to its `NEAR`-th nearest of the sample; all that there can be where the sample is smaller."""
    out = np.full(len(bits), 64 * bits.shape[1], np.int32)
    if len(sample) > NEAR:
        for i in range(len(bits)):
            out[i] = np.partition(footrule(sample, bits[i]), NEAR)[NEAR]
    return out


class Block:
    """An index over some rows: inverted files of their nearest pivots, and their orders as bits."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, perms: Permutations):
        self.ids, self.vectors, self.norms = ids, vectors, _norms(vectors)
        nearest, self.bits = perms.of(vectors, POSTED)
        order = np.argsort(nearest.ravel(), kind="stable")
        self.rows = order // nearest.shape[1]
        self.begin = np.searchsorted(nearest.ravel()[order], np.arange(len(perms.pivots) + 1)).tolist()

    def candidates(self, pivots: np.ndarray, bits: np.ndarray, radius: int) -> np.ndarray:
        hit = np.zeros(len(self.ids), bool)
        for p in pivots.tolist():
            hit[self.rows[self.begin[p] : self.begin[p + 1]]] = True
        found = np.flatnonzero(hit)
        return found[footrule(self.bits[found], bits) <= radius]

    def best(self, found: np.ndarray, query_id: int, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        found = found[self.ids[found] != query_id]
        score = cosines(self.vectors[found], self.norms[found], v)
        top = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found][top], score[top]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Usable rows in blocks of `BLOCK`, whatever the batches."""
    ids, vectors, n = [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            i, x = _usable(b.column("vec_id")[at : at + BLOCK], b.column("embedding")[at : at + BLOCK], width)
            ids.append(i)
            vectors.append(x)
            n += len(i)
            if n >= BLOCK:
                yield np.concatenate(ids), np.concatenate(vectors)
                ids, vectors, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(vectors)


def _best_of_rows(rows: DataFrame, width: int, query_ids: np.ndarray, queries: np.ndarray, k: int, in_block: Callable) -> DataFrame:
    """(query_id, vec_id, score): each task's k best of a query; in_block yields (query number, ids, scores) of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)
        for ids, vectors in _blocks(batches, width):
            for q, i, s in in_block(ids, vectors):
                i, s = np.concatenate([best[q][0], i]), np.concatenate([best[q][1], s])
                top = np.lexsort((i, -s))[:k]
                best[q] = (i[top], s[top])
        each = [len(i) for i, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, each)), pa.array(np.concatenate([i for i, _ in best])), pa.array(np.concatenate([s for _, s in best]))], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def _passes(asked: DataFrame, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries, in blocks that may be sent to all tasks."""
    passes = max(1, -(-asked.count() // max(1, min(QUERIES, QUERY_BYTES // (8 * width)))))
    for p in range(passes):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).toArrow()
        ids, vectors = _usable(own.column("vec_id"), own.column("embedding"))
        if len(ids):
            yield ids, vectors


def _merged(parts: list[DataFrame], k: int) -> DataFrame | None:
    if not parts:
        return None
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, every: int = 50, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row of embeddings(vec_id, embedding) whose id `every` divides."""
    none = embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = embeddings.select("vec_id", "embedding").where("vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)")
    widths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not widths:
        return none
    width = widths[0]["n"]
    rows = rows.where(F.size("embedding") == width)
    hashed = rows.withColumn("h", F.xxhash64("vec_id"))
    chosen = first_rows(hashed, "h", 2 * pivots).groupBy("h").agg(F.min(F.struct("vec_id", "embedding")).alias("r")).orderBy("h").select("r.*").toArrow()
    # Equal pivots would tell nothing apart: of copies one is enough, and half of the rows are spare for that.
    _, first = np.unique(vectors := _usable(chosen.column("vec_id"), chosen.column("embedding"))[1], axis=0, return_index=True)
    perms = Permutations(vectors[np.sort(first)[:pivots]])

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, vectors in _blocks(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in perms.of(vectors, 1)[1]], pa.binary())], names=["bits"])

    known = first_rows(hashed, "h", SAMPLE).groupBy("h").agg(F.min(F.struct("vec_id", "embedding")).alias("r")).select("r.*")
    sample = np.frombuffer(b"".join(sorted(bytes(r.bits) for r in known.mapInArrow(orders, "bits binary").collect())), np.uint64)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def near(ids: np.ndarray, vectors: np.ndarray) -> Callable:
        nearest, bits = perms.of(vectors, PROBED)
        within = radii(bits, sample.reshape(-1, bits.shape[1]))

        def in_block(block_ids: np.ndarray, block_vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            block = Block(block_ids, block_vectors, perms)
            for q in range(len(ids)):
                yield q, *block.best(block.candidates(nearest[q], bits[q], within[q]), ids[q], vectors[q], k)

        return in_block

    def exact(ids: np.ndarray, vectors: np.ndarray) -> Callable:
        def in_block(block_ids: np.ndarray, block_vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            norms = _norms(block_vectors)
            for q in range(len(ids)):
                score = cosines(block_vectors, norms, vectors[q])
                top = np.lexsort((block_ids, -score, block_ids == ids[q]))[:k]
                top = top[block_ids[top] != ids[q]]
                yield q, block_ids[top], score[top]

        return in_block

    found = _merged([_best_of_rows(rows, width, i, x, k, near(i, x)) for i, x in _passes(asked, width)], k)
    if found is None:
        return none
    found = written(found)
    enough = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = _merged([_best_of_rows(rows, width, i, x, k, exact(i, x)) for i, x in _passes(written(asked.join(enough, "vec_id", "left_anti")), width)], k)
    return found if short is None else found.join(enough, found["query_id"] == enough["vec_id"], "left_semi").union(short)
