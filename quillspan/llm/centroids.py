"""Centroid clustering (Lloyd's rounds in integers) with PCA-rotated filtering.

Components become integers floor(256 * x). Every vector is rotated once into the
principal axes of the whole table and written down as its integers, its leading
rotated coordinates (as many axes as hold `SHARE` of the table's variance) and the
norm of the rest. The squared distance to a
centroid is at least that of the leading coordinates plus the squared difference
of the two rest norms; a centroid is looked at in integers only where this bound
does not already exceed the best distance found. So floating point decides what
is looked at (with a margin for its rounding, `SLACK`), and integers decide the
rest: results depend on no rotation, batch or part.

A round reads the rotated table once; a task gives one row a centroid (count and
sums), which Spark adds up, so a cluster that holds most vectors is one row a
task like any other. What comes to the driver is one row a centroid or axis, and
component.

Kept are vectors of `WIDTH` components, none null, non-finite or beyond `LIMIT`
once an integer (a squared distance to such a one might leave a long). First
centroids are the kept rows of the smallest SHA-256 of `seed:vec_id`, ties by
their integers, rows with a null vec_id after all others. Rows that repeat a vec_id, or a vector, are rows each by
itself; of equal centroids the smaller number gets all. Fewer rows than centroids
make as many centroids as rows. No kept rows, no result. Columns beside vec_id and
embedding are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.arrays import small, tidy, written

WIDTH, SCALE, LIMIT = 64, 256, 1 << 26
CENTROIDS, ROUNDS, SEED = 40, 5, 2
#: Share of the variance that the leading coordinates hold.
SHARE = 0.9
#: What rounding may take from a bound, relative to the two squared norms, and at least.
SLACK, LEAST_SLACK = 1e-9, 1e-6

_OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one width, none of them null, as rows of floor(256 * component)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, width)


class Rotation:
    """The axes, and what is kept of a vector in them."""

    def __init__(self, axes: np.ndarray, leading: int):
        self.axes, self.leading = axes, leading

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leading coordinates, norms of the rest)"""
        turned = x.astype(float) @ self.axes
        return turned[:, : self.leading], np.sqrt((turned[:, self.leading :] ** 2).sum(axis=1))


class Centroids:
    """Integer centroids with their rotated form."""

    def __init__(self, x: np.ndarray, rotation: Rotation):
        self.x = x
        self.lead, self.rest = rotation.of(x)
        self.lead_square = (self.lead**2).sum(axis=1)

    def bounds(self, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances of rows to the centroids."""
        square = (lead**2).sum(axis=1)[:, None]
        near = square + self.lead_square - 2 * lead @ self.lead.T + (rest[:, None] - self.rest) ** 2
        return near - SLACK * (square + rest[:, None] ** 2 + self.lead_square + self.rest**2) - LEAST_SLACK

    def nearest(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, squared distance, centroids looked at in integers) of each row's nearest centroid; ties to the smaller number."""
        low = self.bounds(lead, rest)
        first = low.argmin(axis=1)
        number, best = first.copy(), ((x - self.x[first]) ** 2).sum(axis=1)
        seen = np.ones(len(x), np.int32)
        for j in range(len(self.x)):
            at = np.flatnonzero((low[:, j] <= best) & (first != j))
            d = ((x[at] - self.x[j]) ** 2).sum(axis=1)
            wins = (d < best[at]) | ((d == best[at]) & (j < number[at]))
            number[at[wins]], best[at[wins]] = j, d[wins]
            seen[at] += 1
        return number, best, seen


def kept_rows(embeddings: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vec_id, embedding) of the rows that are clustered."""
    bad = f"x -> x is null or isnan(x) or abs(cast(x as double)) >= {LIMIT // SCALE}D"
    return embeddings.select("vec_id", "embedding").where(f"size(embedding) = {width} and not exists(embedding, {bad})")


def first_centroids(rows: DataFrame, k: int, seed: int, width: int) -> np.ndarray:
    named = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    # Ties of the hash (a repeated vec_id) go by the integers.
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    found = named.select("h", ints.alias("x")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in found], np.int64).reshape(-1, width)


def principal(rows: DataFrame, width: int, share: float) -> Rotation:
    """The principal axes of all rows, the widest first; those that hold the share of the variance lead."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for b in small(batches, 4096):
            x = integers(b.column("embedding"), width)
            x = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["axis", "sums"])

    total = np.zeros((width + 1, width + 1))
    parts = rows.select("embedding").mapInArrow(tidy(moments), "axis int, sums array<double>")
    for r in parts.select("axis", F.posexplode("sums")).groupBy("axis", "pos").agg(F.sum("col").alias("s")).collect():
        total[r["axis"], r["pos"]] = r["s"]
    n, mean = total[-1, -1], total[-1, :-1] / total[-1, -1]
    values, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    order = np.argsort(-values, kind="stable")
    held = np.cumsum(np.maximum(values[order], 0))
    return Rotation(axes[:, order], min(width, int(np.searchsorted(held, share * held[-1])) + 1))


def _rotated(rows: DataFrame, rotation: Rotation, width: int) -> DataFrame:
    """(vec_id, ints, lead, rest): a vector's integers and its rotated form, as bytes."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 4096):
            x = integers(b.column("embedding"), width)
            lead, rest = rotation.of(x)
            columns = [b.column("vec_id"), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()), pa.array([r.tobytes() for r in lead], pa.binary()), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "ints", "lead", "rest"])

    return rows.mapInArrow(tidy(turn), "vec_id long, ints binary, lead binary, rest double")


def _parts(batches: Iterator[pa.RecordBatch], width: int, leading: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for b in small(batches, 4096):
        ints = np.frombuffer(b"".join(b.column("ints").to_pylist()), np.int32).reshape(-1, width).astype(np.int64)
        lead = np.frombuffer(b"".join(b.column("lead").to_pylist()), float).reshape(len(ints), leading)
        yield b, ints, lead, b.column("rest").to_numpy()


def _moved(table: DataFrame, now: Centroids, width: int, leading: int) -> np.ndarray:
    """The centroids after a round: exact floors of the means; an empty one stays."""
    k = len(now.x)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, x, lead, rest in _parts(batches, width, leading):
            number = now.nearest(x, lead, rest)[0]
            order = np.argsort(number, kind="stable")
            own, first = np.unique(number[order], return_index=True)
            if len(own):
                sums[own] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(number, minlength=k)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(count[own]), pa.array(list(sums[own]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = table.mapInArrow(tidy(add), "cluster int, n long, sums array<long>")
    added = parts.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
    out = now.x.copy()
    for r in added.collect():  # one row a centroid and component
        out[r["cluster"], r["pos"]] = r["s"] // r["n"]
    return out


def clustered(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_looked_at): a row per kept row of embeddings(vec_id, embedding).

    n_looked_at: centroids whose distance was computed in integers in the last
    assignment; the bound ruled out the others.
    """
    spark = embeddings.sparkSession
    rows = kept_rows(embeddings, width)
    x = first_centroids(rows, k, seed, width)
    if not len(x):
        return spark.createDataFrame([], f"{_OUT}, n_looked_at int")
    rotation = principal(rows, width, share)
    table = written(_rotated(rows, rotation, width))
    for _ in range(rounds):
        moved = _moved(table, Centroids(x, rotation), width, rotation.leading)
        if (moved == x).all():
            break  # further rounds would change nothing
        x = moved
    last = Centroids(x, rotation)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ints, lead, rest in _parts(batches, width, rotation.leading):
            number, distance, seen = last.nearest(ints, lead, rest)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance), pa.array(seen)], names=["vec_id", "cluster", "distance", "n_looked_at"])

    assigned = written(table.mapInArrow(tidy(assign), "vec_id long, cluster int, distance long, n_looked_at int"))
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(inertia.values())
    told = [(j, d, total, hashlib.sha256(",".join(map(str, x[j].tolist())).encode()).hexdigest()) for j, d in inertia.items()]
    of_cluster = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most k rows, a hundred bytes each.
    joined = assigned.join(F.broadcast(of_cluster), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_looked_at")


def clustered_sql(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH) -> str:
    """The same in SQL over embeddings(vec_id, embedding): a step of components by row and number, round by round."""
    steps = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: isfinite(x) AND abs(CAST(x AS DOUBLE)) < {LIMIT // SCALE})) = {width})""",
        f"v AS MATERIALIZED (SELECT r, unnest(x) AS v, unnest(range({width})) AS i FROM e)",
        f"f AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS j, x FROM e QUALIFY j < {k})",
        f"c0 AS MATERIALIZED (SELECT j, unnest(x) AS c, unnest(range({width})) AS i FROM f)",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT r, j, sum((v - c) * (v - c)) AS d FROM v JOIN c{n} USING (i) GROUP BY r, j)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, j, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)")
        if n < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            steps.append(f"m{n} AS (SELECT j, i, {mean} AS c FROM (SELECT j, i, sum(v) AS s, count(*) AS n FROM a{n} JOIN v USING (r) GROUP BY j, i))")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT j, i, CAST(coalesce(m{n}.c, c{n}.c) AS BIGINT) AS c FROM c{n} LEFT JOIN m{n} USING (j, i))")
    steps.append(f"h AS (SELECT j, sha256(string_agg(c, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY j)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN e USING (r) JOIN h USING (j)"""
