"""Hard negatives by lists of candidates that anchors of one cluster share.

Scores are inner products of integers floor(256 * component). Anchors are
clustered by direction. For a cluster with centre c and widest angle w to a
member, an anchor u and a candidate v have the score |u| |v| cos(angle(u, v)), and
angle(u, v) >= angle(c, v) - w; so |v| cos(max(0, angle(c, v) - w)) bounds the
score a unit of |u| for every member. Each cluster's candidates are sorted by that
bound once, and every member walks the list, with exact scores, until what it has
found is certain: when its last place beats the bound of all that is left.

There are two walks. The first finds each anchor's positives, in the part of the
list that has its label. The second, with the positives of all parts known, finds
for each positive score the best rows of other labels within [80 %, 100 %] of it;
that walk also ends where the bound falls below the lowest of these floors.

Rows stay where they are: anchors go out in blocks bounded by rows and bytes
(`ANCHORS`, `ANCHOR_BYTES`; more anchors take several passes), a task sorts and
walks the rows it reads, a block of `BLOCK` at a time with what is found so far,
and gives k rows an anchor (or positive score), which a window merges. A label or
a vector that a third of all rows share loads no task more than its own rows.
Floating point only orders and bounds (with a margin, `SLACK`); results depend on
no batch, part or cluster.

Rows with a null vec_id, label or vector, a null or non-finite component, another
width than most (of equally frequent ones the smaller; 0 is none), or a component
beyond what keeps 100 scores within a long take no part. Rows that repeat a vec_id
are candidates each by itself, one anchor together (the first by label and values)
and never candidates of that anchor. A positive of negative score has no
negatives, since 80 % of it is more than it. Anchors without positives, and
positives without negatives, give no rows. Columns beside vec_id, embedding and
label are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.arrays import tidy, written
from quillspan.llm.centroids import SCALE, integers

EVERY, K = 100, 5
#: Percent of a positive's score that a negative's may be.
LOW, HIGH = 80, 100
BLOCK, STEP = 8192, 1024
ANCHORS, ANCHOR_BYTES = 4096, 8 << 20
#: Anchors a cluster, at the mean; most clusters of a block.
MEMBERS, MOST_CLUSTERS = 32, 64
#: What rounding may add to a bound, relative to the two norms, and to an angle.
SLACK = 1e-9
ANGLE_SLACK = 1e-7
#: 100 * score stays within a long up to here.
MOST_SCORE = 1 << 56

_FOUND = "anchor_id long, floor_of long, vec_id long, score long"


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; in floating point where all sums stay whole there."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if top < 1 << 52 else a @ b.T


class Anchors:
    """A block of anchors, clustered by direction."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        unit = x / np.maximum(self.norms, 1e-300)[:, None]
        k = int(min(MOST_CLUSTERS, max(1, len(x) // MEMBERS)))
        centres = unit[np.arange(k) * len(x) // k]
        for _ in range(8):
            own = (unit @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, unit)
            size = np.sqrt((sums**2).sum(axis=1))
            centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
        own = (unit @ centres.T).argmax(axis=1)
        #: (direction, widest angle, members) of each cluster.
        self.clusters = []
        for j in range(k):
            members = np.flatnonzero(own == j)
            if len(members):
                angles = np.arccos(np.clip(unit[members] @ centres[j], -1, 1))
                self.clusters.append((centres[j], float(angles.max()), members))


class SharedList:
    """Rows by what bounds the score of any member a unit of its norm, from the highest."""

    def __init__(self, x: np.ndarray, norms: np.ndarray, centre: np.ndarray, widest: float):
        cosine = np.clip((x @ centre) / np.maximum(norms, 1e-300), -1, 1)
        apart = np.maximum(np.arccos(cosine) - widest - ANGLE_SLACK, 0)
        self.bound = norms * (np.cos(apart) + SLACK)
        self.order = np.argsort(-self.bound, kind="stable")

    def walk(self, rows: np.ndarray, members: np.ndarray, anchors: Anchors, x: np.ndarray, certain: Callable, offer: Callable) -> int:
        """Members see `rows` of the list, a stretch at a time, until each is certain; gives back how many pairs were scored."""
        at = scored = 0
        while at < len(rows):
            part = rows[at : at + STEP]
            bound = self.bound[part[0]]
            members = np.array([m for m in members if not certain(m, bound * anchors.norms[m])], np.int64)
            if not len(members):
                break
            for m, s in zip(members.tolist(), dots(anchors.x[members], x[part]), strict=True):
                offer(m, part, s)
            scored += len(members) * len(part)
            at += STEP
        return scored


class Best:
    """The k best (score, then smaller id) offered so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            at = np.flatnonzero(scores >= self.scores[-1])
            scores, ids = scores[at], ids[at]
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            top = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[top], ids[top]

    def beats(self, bound: float) -> bool:
        """Whether nothing of at most this score can come in, ties included."""
        return len(self.scores) == self.k and self.scores[-1] > bound


class Positives:
    """Each anchor's best rows of its own label."""

    def __init__(self, anchors: Anchors, k: int):
        self.anchors = anchors
        self.best = {m: [(0, Best(k))] for m in range(len(anchors.ids))}

    def see(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> int:
        norms, scored = np.sqrt((x.astype(float) ** 2).sum(axis=1)), 0
        for centre, widest, members in self.anchors.clusters:
            listed = SharedList(x, norms, centre, widest)
            for label in np.unique(self.anchors.labels[members]).tolist():
                rows = listed.order[labels[listed.order] == label]
                own = members[self.anchors.labels[members] == label]

                def offer(m: int, part: np.ndarray, s: np.ndarray) -> None:
                    other = ids[part] != self.anchors.ids[m]
                    self.best[m][0][1].offer(s[other], ids[part][other])

                scored += listed.walk(rows, own, self.anchors, x, lambda m, bound: self.best[m][0][1].beats(bound), offer)
        return scored


class Negatives:
    """For each anchor and score of a positive, the best rows of other labels within its band."""

    def __init__(self, anchors: Anchors, k: int, scores: dict[int, list[int]], low: int, high: int):
        self.anchors, self.low, self.high = anchors, low, high
        self.best = {m: [(s, Best(k)) for s in scores.get(int(i), []) if low * s <= high * s] for m, i in enumerate(anchors.ids)}

    def certain(self, m: int, bound: float) -> bool:
        return all(best.beats(bound) or 100 * bound < self.low * s for s, best in self.best[m])

    def see(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> int:
        norms, scored = np.sqrt((x.astype(float) ** 2).sum(axis=1)), 0

        def offer(m: int, part: np.ndarray, s: np.ndarray) -> None:
            other = (labels[part] != self.anchors.labels[m]) & (ids[part] != self.anchors.ids[m])
            for positive, best in self.best[m]:
                fits = other & (self.low * positive <= 100 * s) & (100 * s <= self.high * positive)
                best.offer(s[fits], ids[part][fits])

        for centre, widest, members in self.anchors.clusters:
            listed = SharedList(x, norms, centre, widest)
            scored += listed.walk(listed.order, members, self.anchors, x, self.certain, offer)
        return scored


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, integers) in blocks of `BLOCK` rows, whatever the batches."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            s = b.slice(at, BLOCK)
            held.append((s.column("vec_id").to_numpy(), s.column("label").to_numpy(), integers(s.column("embedding"), width)))
            n += s.num_rows
            if n >= BLOCK:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _found(rows: DataFrame, width: int, make: Callable) -> DataFrame:
    """What each task's walks over its rows find; make() gives the Positives or Negatives of a block of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = make()
        for block in _blocks(batches, width):
            walks.see(*block)
        out = [(np.full(len(b.ids), walks.anchors.ids[m]), np.full(len(b.ids), s), b.ids, b.scores) for m, bands in walks.best.items() for s, b in bands if len(b.ids)]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["anchor_id", "floor_of", "vec_id", "score"])

    return rows.mapInArrow(tidy(run), _FOUND)


def _merged(parts: list[DataFrame], k: int) -> DataFrame:
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "floor_of").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, every: int = EVERY, k: int = K, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of embeddings(vec_id, embedding, label).

    Anchors are the rows whose vec_id `every` divides.
    """
    spark = embeddings.sparkSession
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where("vec_id is not null and label is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    widths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not widths:
        return none
    width = widths[0]["n"]
    most = int((MOST_SCORE / width) ** 0.5) // SCALE
    rows = rows.where(f"size(embedding) = {width} and not exists(embedding, x -> abs(cast(x as double)) >= {most}D)")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.*")
    asked = written(asked)
    passes = max(1, -(-asked.count() // max(1, min(ANCHORS, ANCHOR_BYTES // (8 * width)))))

    def blocks() -> Iterator[tuple[int, Anchors]]:
        for p in range(passes):
            own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).orderBy("vec_id").toArrow()
            if own.num_rows:
                column = own.column("embedding").combine_chunks()
                yield p, Anchors(own.column("vec_id").to_numpy(), own.column("label").to_numpy(), integers(column, width))

    near = [_found(rows, width, lambda anchors=anchors: Positives(anchors, k)) for _, anchors in blocks()]
    if not near:
        return none
    positives = written(_merged(near, k).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    def scores_of(p: int) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for r in positives.where(F.pmod(F.xxhash64("anchor_id"), F.lit(passes)) == p).select("anchor_id", "positive_score").distinct().collect():
            out.setdefault(r["anchor_id"], []).append(r["positive_score"])
        return out

    hard = [_found(rows, width, lambda anchors=anchors, scores=scores_of(p): Negatives(anchors, k, scores, low, high)) for p, anchors in blocks()]
    negatives = _merged(hard, k).select("anchor_id", F.col("floor_of").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    # At most k positives and k negatives an anchor and score meet here.
    return positives.join(negatives, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
