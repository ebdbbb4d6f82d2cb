"""Vector search by cosine distance: one query, many queries, and by inverted lists of 8-bit codes.

No search moves a vector: a task keeps a query's nearest rows of what it reads, and
only their ids meet the chunks. As vectors without a chunk do not count, a query
gets `k` and as many rows again; one that loses more than those to such orphans is
asked once more of the vectors that have a chunk.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.text import cosine_distance, norm
from quillspan.sources.store import kept, scratch_dir

#: Queries that are sent to the executors at once; more take several passes.
QUERY_BLOCK, QUERY_BYTES = 4096, 16 << 20
FOUND = "query_id string, chunk_id string, distance double"
#: Rows whose distances to all queries of a block are held at once.
ROW_BLOCK = 2048
#: Rows of the nearest that a driver may hold; beyond that, all vectors are joined first.
MOST_HELD = 10_000
#: Bytes of vectors that first centres are fitted on, rows that a large list's own are fitted on, and Lloyd's rounds.
SAMPLE_BYTES, SPLIT_SAMPLE, ROUNDS = 64 << 20, 4096, 10


def _with_chunks(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    return embeddings.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")


def _places(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("id").alias("chunk_id"), "file_path", "start_line", "end_line")


def search(chunks: DataFrame, embeddings: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """(chunk_id, file_path, start_line, end_line, distance) of the k nearest chunks, ascending.

    Vectors without a chunk row do not count; a zero vector's distance is null and
    comes last. Distances are ordered at nine decimals, then by id.
    """
    distance = cosine_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    order = (F.round("distance", 9).asc_nulls_last(), "chunk_id")
    near = embeddings.select("chunk_id", distance.alias("distance"))
    own, margin = _places(chunks), 2 * k
    while 0 < margin <= MOST_HELD:
        rows = near.orderBy(*order).limit(margin).collect()
        some = embeddings.sparkSession.createDataFrame(rows, "chunk_id string, distance double")
        # Few rows of ids and distances, bounded above; the chunks stay where they are.
        found = own.join(F.broadcast(some), "chunk_id").orderBy(*order).limit(k).collect()
        if len(found) == k or len(rows) < margin:
            columns = "chunk_id string, file_path string, start_line int, end_line int, distance double"
            return embeddings.sparkSession.createDataFrame(found, columns).coalesce(1).sortWithinPartitions(*order)
        margin *= 8
    known = _with_chunks(near, chunks)
    return known.orderBy(*order).limit(k).join(own, "chunk_id").orderBy(*order).select("chunk_id", "file_path", "start_line", "end_line", "distance")


class _Best:
    """The k nearest rows of each query so far: by `near` (nine decimals, none last), then ids. One array entry a row held."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.size, self.k = queries, np.linalg.norm(queries, axis=1), k
        self.of, self.near, self.exact, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, "U1")
        #: What a row must not be beyond to come in: a query's k-th place, once there are k.
        self.limit = np.full(len(queries), np.inf)

    def add(self, chunk: list[str], x: np.ndarray) -> None:
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 1 - (self.queries @ x.T) / (self.size[:, None] * np.linalg.norm(x, axis=1))
        near = np.where(np.isfinite(d), d, np.inf)
        limit = self.limit
        if near.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(near, self.k - 1, axis=1)[:, self.k - 1])
        q, j = np.nonzero(near <= limit[:, None] + 1e-9)
        if not len(q):
            return
        ids = np.array(chunk, dtype=str)
        of, near = np.concatenate([self.of, q]), np.concatenate([self.near, np.round(near[q, j], 9)])
        exact, ids = np.concatenate([self.exact, d[q, j]]), np.concatenate([self.ids, ids[j]])
        order = np.lexsort((ids, near, of))
        of = of[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        top, full = order[rank < self.k], order[rank == self.k - 1]
        self.limit[of[rank == self.k - 1]] = near[full]
        self.of, self.near, self.exact, self.ids = of[rank < self.k], near[top], exact[top], ids[top]

    def rows(self, query_ids: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([query_ids[i] for i in self.of.tolist()], pa.string()), pa.array(self.ids.tolist(), pa.string()), pa.array([v if np.isfinite(v) else None for v in self.exact.tolist()], pa.float64())],
            names=["query_id", "chunk_id", "distance"],
        )


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1) if rows else np.zeros((0, 0))


def _nearest(batches: Iterator[pa.RecordBatch], ids: list, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """A matrix product per block of rows; each query's k nearest rows leave the task, once."""
    best = _Best(queries, k)
    for b in batches:
        for at in range(0, b.num_rows, ROW_BLOCK):
            chunk = b.column("chunk_id")[at : at + ROW_BLOCK].to_pylist()
            best.add(chunk, _matrix(b.column("embedding")[at : at + ROW_BLOCK], len(chunk)))
    yield best.rows(ids)


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Queries in blocks bounded by rows and by bytes."""
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding")
    count, width = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-count // max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * max(width or 1, 1))))))
    for n in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).orderBy("query_id").toArrow()
        if own.num_rows:
            yield own.column("query_id").to_pylist(), np.array(own.column("embedding").to_pylist(), float)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9).asc_nulls_last(), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _top(found: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    return _ranked(found.join(_places(chunks), "chunk_id"), k).select("query_id", "rank", "chunk_id", "file_path", "start_line", "end_line", "distance")


def _united(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    found = spark.createDataFrame([], FOUND)
    for p in parts:
        found = found.union(p)
    return found


def _answered(ask: Callable[[DataFrame, int, bool], DataFrame], chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """ask(queries, k, among chunks only) gives each query's nearest; queries that orphans leave short of k are asked again, among rows with chunks only."""
    margin, root = 2 * k, scratch_dir(chunks.sparkSession)
    near = kept(_ranked(ask(queries, margin, False), margin).drop("rank"), f"{root}/near")
    known = kept(near.join(_places(chunks), "chunk_id"), f"{root}/known")
    had = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("had")).where(F.col("had") == margin)
    left = known.groupBy("query_id").agg(F.count(F.lit(1)).alias("left"))
    short = had.join(left, "query_id", "left").where(F.coalesce("left", F.lit(0)) < k).select("query_id")
    columns = ["query_id", "rank", "chunk_id", "file_path", "start_line", "end_line", "distance"]
    out = _ranked(known, k).select(columns)
    if short.isEmpty():
        return out
    short = kept(short, f"{root}/short")
    again = queries.withColumn("query_id", F.col("query_id").cast("string")).join(short, "query_id", "left_semi")
    return out.join(short, "query_id", "left_anti").select(columns).union(_top(ask(again, k, True), chunks, k))


def search_batch(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """As search, for each row of queries(query_id, embedding), with query_id and rank.

    Queries go out in blocks of a bounded size; only the nearest rows of a query
    leave a task.
    """

    def ask(some: DataFrame, n: int, with_chunks: bool) -> DataFrame:
        rows = (_with_chunks(embeddings, chunks) if with_chunks else embeddings).select("chunk_id", "embedding")
        return _united([rows.mapInArrow(lambda batches, ids=ids, vectors=vectors: _nearest(batches, ids, vectors, n), FOUND) for ids, vectors in _blocks(some)], chunks.sparkSession)

    return _answered(ask, chunks, queries, k)


@dataclass
class Lists:
    """Inverted lists in a folder: `codes` by list and shard, full `vectors` by id, and the lists' centres.

    A code is a unit vector's components in 8 bits, in steps of its largest one, and
    `off` is how far the coded vector lies from the true one, so distances to codes
    come with bounds. `twin` is a hash that equal vectors share.
    """

    path: str
    codes: DataFrame
    vectors: DataFrame
    centres: np.ndarray
    shards: list[int]


_CODES = "chunk_id string, code binary, step float, off float, twin long, list int, shard int"
_VECTORS = "chunk_id string, embedding array<float>"


def _closest(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each vector's unit vector: squared distances are the centres' norms less twice the products, and a constant."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    return np.argsort((centres**2).sum(axis=1) - 2 * (unit @ centres.T), axis=1, kind="stable")[:, :n]


def _fitted(unit: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres of unit vectors by Lloyd's rounds from k different ones."""
    unit = np.unique(unit, axis=0)
    k = min(k, len(unit))
    centres = unit[np.sort(np.random.default_rng(seed).permutation(len(unit))[:k])]
    for _ in range(ROUNDS):
        own = _closest(unit, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        count = np.bincount(own, minlength=k)[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres


def codes_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, steps, distances of the coded from the true unit vectors)"""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    step = (np.abs(unit).max(axis=1, initial=0) / 127).astype(np.float32)
    code = np.clip(np.rint(unit / np.maximum(step.astype(float), 1e-300)[:, None]), -127, 127).astype(np.int8)
    off = np.linalg.norm(unit - code * step.astype(float)[:, None], axis=1)
    return code, step, np.nextafter(off.astype(np.float32), np.float32(np.inf))


def build_ann(embeddings: DataFrame, n_lists: int = 16, seed: int = 7, sample_bytes: int = SAMPLE_BYTES, path: str | None = None) -> Lists:
    """Lists around centres of unit vectors, written once to a folder (one of its own without path) from which `load_ann` reads them again.

    First centres are fitted on a bounded sample. A list of more than twice the mean
    is split by centres fitted on rows of its own, and what is still too large,
    such as copies of one vector, lies in several shards; so no part holds more
    than twice the mean that is asked for. Null vectors are left out; a zero vector
    is in the list whose centre is nearest to zero.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("chunk_id", "embedding", F.xxhash64("embedding").alias("twin")).where("embedding is not null")
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    known, width = width is not None, width or 1
    some = rows.where(norm(F.col("embedding")) > 0).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(max(1, sample_bytes // (4 * width))).toArrow()
    x = np.array(some.column("embedding").to_pylist(), float).reshape(some.num_rows, width)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centres = _fitted(x, n_lists, seed) if len(x) else np.zeros((int(known), width))

    def counted(centres: np.ndarray) -> dict[int, int]:
        return {r["list"]: r["count"] for r in assigned(centres).groupBy("list").count().collect()}

    def assigned(centres: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column("embedding"), b.num_rows)
                which = _closest(x, centres, 1)[:, 0] if len(x) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(which, pa.int32())], names=[*b.schema.names, "list"])

        return rows.mapInArrow(run, f"{_VECTORS}, twin long, list int")

    sizes = counted(centres)
    most = 2 * sum(sizes.values()) / max(1, n_lists)
    large = {j: n for j, n in sizes.items() if n > most}
    if large:
        centres = _split(assigned(centres), centres, large, most / 2, seed)
        sizes = counted(centres)
    shards = [max(1, -(-sizes.get(j, 0) // max(1, int(most)))) for j in range(len(centres))]
    shards = [1 if s == 1 else 2 * s for s in shards]  # a hash deals rows a little unevenly

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.array(shards, int)
        for b in batches:
            which = b.column("list").to_numpy()
            code, step, off = codes_of(_matrix(b.column("embedding"), b.num_rows)) if b.num_rows else (np.zeros((0, 0), np.int8), np.zeros(0, np.float32), np.zeros(0, np.float32))
            shard = b.column("hash").to_numpy() % many[which]
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step), pa.array(off), b.column("twin"), pa.array(which, pa.int32()), pa.array(shard, pa.int32())], names=[c.split(" ")[0] for c in _CODES.split(", ")])

    path = path or scratch_dir(spark)
    hashed = assigned(centres).withColumn("hash", F.xxhash64("chunk_id"))
    hashed.mapInArrow(code, _CODES).repartition("list", "shard").write.partitionBy("list", "shard").parquet(f"{path}/codes")
    # By id, so that the pages beside the rows that are ranked again are skipped.
    rows.select("chunk_id", "embedding").repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.parquet(f"{path}/vectors")
    about = json.dumps({"centres": centres.tolist(), "shards": shards})
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.parquet(f"{path}/about")
    return load_ann(spark, path)


def load_ann(spark: SparkSession, path: str) -> Lists:
    about = json.loads(spark.read.schema("about string").parquet(f"{path}/about").first()[0])
    return Lists(path, spark.read.schema(_CODES).parquet(f"{path}/codes"), spark.read.schema(_VECTORS).parquet(f"{path}/vectors"), np.array(about["centres"]), about["shards"])


def _split(rows: DataFrame, centres: np.ndarray, large: dict[int, int], target: float, seed: int) -> np.ndarray:
    """Centres with those of large lists replaced by several of their own, each fitted on a bounded sample of its list."""
    part = F.create_map(*[F.lit(v) for j, n in large.items() for v in (j, max(1, n // SPLIT_SAMPLE))])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        j = int(group["list"].iloc[0])
        x = np.array(group["embedding"].tolist(), float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        own = _fitted(x, max(2, int(np.ceil(large[j] / target))), seed)
        return pd.DataFrame({"list": [j] * len(own), "centre": own.tolist()})

    some = rows.where(F.col("list").isin(list(large))).where(F.pmod(F.xxhash64("chunk_id", F.lit(1)), part[F.col("list")]) == 0)
    made = some.groupBy("list").applyInPandas(fit, "list int, centre array<double>").collect()
    gone = {r["list"] for r in made}
    stay = [c for j, c in enumerate(centres) if j not in gone]
    return np.array([*stay, *[r["centre"] for r in sorted(made, key=lambda r: (r["list"], r["centre"]))]])


class _Bounded:
    """Rows that may be among the k nearest of a query, by bounds of their distances; one array entry a row held."""

    def __init__(self, n: int, k: int):
        self.k, self.limit = k, np.full(n, np.inf)
        self.parts: list[tuple] = []
        self.held, self.most = 0, 4 * k * n + (1 << 16)

    def add(self, mine: np.ndarray, low: np.ndarray, high: np.ndarray, names: np.ndarray, twins: np.ndarray) -> None:
        """Bounds of rows (columns) for the queries `mine`; none is infinite."""
        if high.shape[1] >= self.k:
            self.limit[mine] = np.minimum(self.limit[mine], np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
        q, j = np.nonzero(low <= self.limit[mine][:, None])
        self.parts.append((mine[q], low[q, j], high[q, j], names[j], twins[j]))
        self.held += len(q)
        if self.held > self.most:
            self.rows()

    def rows(self) -> tuple[np.ndarray, ...]:
        """(query, low, high, id, twin) of what is left: all that the k-th upper bound allows, of equal vectors and of rows without a distance the k smallest ids."""
        of, low, high, names, twins = (np.concatenate(c) for c in zip((np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, "U1"), np.zeros(0, np.int64)), *self.parts, strict=True))
        order = np.lexsort((names, high, of))
        of, low, high, names, twins = (c[order] for c in (of, low, high, names, twins))
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        self.limit[of[rank == self.k - 1]] = high[rank == self.k - 1]
        stay = (low <= self.limit[of]) & (np.isfinite(high) | (rank < self.k))
        by = np.lexsort((names, twins, of))
        first = np.flatnonzero(np.concatenate([[True], (of[by][1:] != of[by][:-1]) | (twins[by][1:] != twins[by][:-1])])) if len(by) else by
        turn = np.empty(len(of), np.int64)
        turn[by] = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        stay &= turn < self.k
        self.parts, self.held = [tuple(c[stay] for c in (of, low, high, names, twins))], int(stay.sum())
        self.most = max(self.most, 2 * self.held)
        return self.parts[0]


def _coded(batches: Iterator[pa.RecordBatch], ids: list, queries: np.ndarray, probes: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, chunk_id, low, high): bounds of the distances of rows that may be among a query's k nearest of the task."""
    size = np.linalg.norm(queries, axis=1)
    unit = queries / np.maximum(size, 1e-300)[:, None]
    held = _Bounded(len(queries), k)
    for b in batches:
        of = b.column("list").to_numpy()
        for which in np.unique(of).tolist():
            mine, rows = np.flatnonzero((probes == which).any(axis=1)), np.flatnonzero(of == which)
            for at in range(0, len(rows) if len(mine) else 0, ROW_BLOCK):
                some = b.take(pa.array(rows[at : at + ROW_BLOCK]))
                step = some.column("step").to_numpy().astype(float)
                x = np.frombuffer(b"".join(some.column("code").to_pylist()), np.int8).reshape(some.num_rows, -1) * step[:, None]
                d = 1 - unit[mine] @ x.T
                # The products of a query's and two unit vectors differ by no more than the vectors do; and a little for rounding.
                off = some.column("off").to_numpy().astype(float) + 1e-6
                none = (step == 0) | (size[mine, None] == 0)  # no distance: these come last, by id
                held.add(mine, np.where(none, np.inf, d - off), np.where(none, np.inf, d + off), np.array(some.column("chunk_id").to_pylist(), dtype=str), some.column("twin").to_numpy())
    of, low, high, names, _ = held.rows()
    yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in of.tolist()], pa.string()), pa.array(names.tolist(), pa.string()), pa.array(low), pa.array(high)], names=["query_id", "chunk_id", "low", "high"])


def _probed(lists: Lists, probes: np.ndarray) -> DataFrame:
    """The codes of some lists; only their folders are read, and no vector."""
    return lists.codes.where(F.col("list").isin(np.unique(probes).tolist())).select("chunk_id", "code", "step", "off", "twin", "list")


def search_ann(lists: Lists, chunks: DataFrame, queries: DataFrame, k: int = 10, n_probe: int = 4) -> DataFrame:
    """As search_batch over the rows of each query's n_probe nearest lists; all lists give search_batch's result.

    Only the lists that a block's queries probe are read, by partition pruning, and
    of them the codes, a quarter of the vectors' bytes. Rows that may be among the
    nearest by their codes' bounds are ranked again by their full vectors.
    """

    def ask(some: DataFrame, n: int, with_chunks: bool) -> DataFrame:
        parts = []
        for ids, vectors in _blocks(some) if len(lists.centres) else ():
            probes = _closest(vectors, lists.centres, n_probe)
            read = _with_chunks(_probed(lists, probes), chunks) if with_chunks else _probed(lists, probes)
            parts.append(read.mapInArrow(lambda batches, ids=ids, vectors=vectors, probes=probes: _coded(batches, ids, vectors, probes, n), "query_id string, chunk_id string, low double, high double"))
        if not parts:
            return _united([], chunks.sparkSession)
        bounds = parts[0]
        for p in parts[1:]:
            bounds = bounds.union(p)
        bounds = kept(bounds, scratch_dir(chunks.sparkSession))
        turn = F.row_number().over(Window.partitionBy("query_id").orderBy("high", "chunk_id"))
        limit = bounds.withColumn("turn", turn).where(F.col("turn") <= n).groupBy("query_id").agg(F.max("high").alias("limit"), F.max("turn").alias("turns"))
        may = bounds.join(limit, "query_id").where((F.col("low") <= F.col("limit")) | (F.col("turns") < n)).select("query_id", "chunk_id")
        asked = some.select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").alias("__q"))
        exact = lists.vectors.join(may, "chunk_id").join(asked, "query_id")
        return exact.select("query_id", "chunk_id", cosine_distance(F.col("embedding"), F.col("__q")).alias("distance"))

    return _answered(ask, chunks, queries, k)
