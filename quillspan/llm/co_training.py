"""Quality classifier by co-training of two views.

One view is the text's content: which words it has (lower case, hashed), and how
often it repeats words and pairs of words. The other is what describes the page:
its source, language and length, and the layout of its text (lines, marks,
capitals, digits), without any word. Each view has a logistic regression, fitted
here. In every round both score all rows of the corpus that are not learned from,
each task keeps its surest, and the rows a view is surest of (in the proportion of
the labels, `grow` of the labelled rows at most) are offered, with its label, to
the *other* view. A row is offered to a view once: what has been offered, whether
it was kept or not, leaves that view's pool, so that each round brings the next
surest, and all rounds together offer `rounds * grow` of the labelled rows at most.
The view learns from them if that does not make the two views combined worse on
labelled rows that were kept apart for this. Then each view is calibrated and the
calibrated views are combined, by logistic fits on two further parts of the
labelled rows.

The fit reads a bounded sample of labelled rows, `labelled`, the first by a hash
of doc_id: five eighths teach, one eighth each calibrates the offers, judges them,
and calibrates and combines the views in the end. Features are computed once, from
whole texts, and written; rounds and the last scoring read them. Only the features
of labelled and exchanged rows come to the driver, one row for each text of a
doc_id.

Null texts score as empty ones. Labels that are null do not count; where labels
of one doc_id differ the smallest is taken. Without labels of both kinds the
score is the known share of 1 (0.5 without labels). Rows with a null or repeated
doc_id are scored each by itself. Very long texts are rows like others. An empty
table gives no rows. Columns beside doc_id, text, lang, source and n_chars are not
read; of these, all but doc_id and text may be missing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.arrays import Words, as_bytes, mix, pieces, sized, small, starts_of, tidy, written

LABELLED, ROUNDS, GROW, PLACES, META = 12_000, 3, 0.06, 1 << 17, 1 << 11


#: Calibrated log odds from which a view is sure of a row (19 to 1), so that a view that knows nothing about a rare label tells nothing.
SURE = 2.94
#: Kinds of bytes: 1 capital, 2 digit, 3 other printable ASCII that is no letter, 4 line feed.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[10] = 1, 0, 2, 4


class Rows:
    """Sparse binary features: `place` of each entry, `count` entries a row."""

    def __init__(self, place: np.ndarray, count: np.ndarray):
        self.place, self.count, self.begin = place, count, starts_of(count)

    def __len__(self) -> int:
        return len(self.count)

    def take(self, rows: np.ndarray) -> Rows:
        n = self.count[rows]
        inside = np.arange(n.sum()) - np.repeat(starts_of(n), n)
        return Rows(self.place[np.repeat(self.begin[rows], n) + inside], n)

    def sums(self, w: np.ndarray) -> np.ndarray:
        """Each row's sum of weights, the same whatever rows are beside it."""
        out, some = np.zeros(len(self)), self.count > 0
        if some.any():
            out[some] = np.add.reduceat(w[self.place], self.begin[some])
        return out


def _of(texts: list[bytes], lang: list, source: list, n_chars: list) -> tuple[Rows, Rows]:
    """The content and the metadata features of some rows."""
    words = Words(texts, lower=True)
    doc = np.repeat(np.arange(len(texts)), words.counts)
    key = np.unique(doc * PLACES + (words.hashes % np.uint64(PLACES - 64)).astype(np.int64))
    distinct = np.bincount(key // PLACES, minlength=len(texts))
    n = np.maximum(words.counts, 1)
    pairs = np.zeros(len(texts), np.int64)
    if len(words.hashes) > 1:
        two = mix(words.hashes[:-1] * np.uint64(3) + words.hashes[1:])[doc[:-1] == doc[1:]]
        pair_doc = doc[:-1][doc[:-1] == doc[1:]]
        pairs = np.bincount(np.unique(pair_doc * PLACES + (two % np.uint64(PLACES)).astype(np.int64)) // PLACES, minlength=len(texts))
    # The last places are for how much of the text repeats.
    row = np.arange(len(texts)) * PLACES
    repeats = [row + PLACES - 64 + 32 * k + np.clip((x / n * 24).astype(int), 0, 31) for k, x in enumerate((distinct, pairs))]
    key = np.sort(np.concatenate([key, *repeats]))
    content = Rows(key % PLACES, np.bincount(key // PLACES, minlength=len(texts)))

    at = starts_of(np.array([len(t) + 1 for t in texts] + [0], np.int64))

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), at))

    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    size = np.maximum(np.diff(at) - 1, 1)
    upper, digit, mark, lines = (per_text(_CLASS[raw] == k) for k in (1, 2, 3, 4))
    lines = lines + 1
    known = np.array([c if c is not None else s for c, s in zip(n_chars, size.tolist(), strict=True)], float)
    shares = [upper / size, digit / size, mark / n, size / n / 20, lines / n, np.log2(np.maximum(known, 1)) / 20, np.log2(n) / 16, np.log2(lines) / 10]
    bins = np.stack([np.clip((s * 24).astype(int), 0, 31) + 32 * k for k, s in enumerate(shares)], axis=1)
    crossed = 256 + (bins[:, 0] % 32) // 4 * 32 + bins[:, 2] % 32
    named = [[512 + _name(x) % 256, 1024 + _name(y) % 1024] for x, y in zip(lang, source, strict=True)]
    both = np.concatenate([bins, crossed[:, None], np.array(named, np.int64).reshape(len(texts), 2)], axis=1)
    return content, Rows(both.ravel(), np.full(len(texts), both.shape[1]))


def _name(value) -> int:
    """A number for a whole name; null has one of its own."""
    return int.from_bytes(hashlib.blake2b(b"" if value is None else b"." + str(value).encode("utf-8", "replace"), digest_size=6).digest(), "little")


class Logistic:
    """Logistic regression with an L1 penalty, by AdaGrad with soft thresholds."""

    def __init__(self, places: int):
        self.w, self.bias = np.zeros(places), 0.0

    def fit(self, x: Rows, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 2e-4, steps: int = 90, rate: float = 0.4) -> Logistic:
        w, g2, bias, b2 = np.zeros_like(self.w), np.full_like(self.w, 1e-6), 0.0, 1e-6
        weight = np.ones(len(y)) if weight is None else weight
        weight = weight / weight.sum()
        for _ in range(steps):
            d = (_sigmoid(x.sums(w) + bias) - y) * weight
            g = np.bincount(x.place, weights=np.repeat(d, x.count), minlength=len(w))
            g2 += g * g
            step = rate / np.sqrt(g2)
            w -= step * g
            w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
            b2 += d.sum() ** 2
            bias -= rate * d.sum() / np.sqrt(b2)
        self.w, self.bias = w, bias
        return self

    def score(self, x: Rows) -> np.ndarray:
        return x.sums(self.w) + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _line(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Weights of a small logistic fit with a constant column last, by Newton steps with a slight ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(move, -3, 3)
    return w


def _joined(rows: list[Rows]) -> Rows:
    return Rows(np.concatenate([r.place for r in rows]), np.concatenate([r.count for r in rows]))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0.5, -z, z)).mean())


class CoTrained:
    """Both views of one label, their calibrations and the combination.

    `offers` says how much each view asks of its surest rows; `teach` gives the
    other view those rows; `finish` calibrates and combines; `score` gives
    (combined, content, metadata) probabilities.
    """

    def __init__(self, views: tuple[Rows, Rows], y: np.ndarray, grow: float = GROW):
        self.share = float(y.mean()) if len(y) else 0.5
        self.grow, self.top = grow, None
        part = np.array([0, 0, 0, 0, 0, 1, 2, 3])[np.arange(len(y)) % 8]
        if len(part) and all(len(set(y[part == k])) == 2 for k in range(4)):
            self.y = [y[part == k] for k in range(4)]
            self.rows = [[v.take(np.flatnonzero(part == k)) for k in range(4)] for v in views]
            self.told: list[tuple[Rows, np.ndarray]] = [(v[0].take(np.zeros(0, np.int64)), np.zeros(0)) for v in self.rows]
            self.views = [self._fit(k, *self.told[k]) for k in (0, 1)]
            self.lines = [self._line(k, 1) for k in (0, 1)]
        else:
            self.views = None

    def _fit(self, k: int, more: Rows, labels: np.ndarray) -> Logistic:
        weight = np.concatenate([np.ones(len(self.y[0])), np.full(len(labels), 0.5)])
        return Logistic((PLACES, META)[k]).fit(_joined([self.rows[k][0], more]), np.concatenate([self.y[0], labels]), weight)

    def _line(self, k: int, part: int) -> np.ndarray:
        return _line(self.views[k].score(self.rows[k][part])[:, None], self.y[part])

    def _judged(self) -> float:
        """Loss of the combined score on the judging part; combined on the part that calibrates the offers."""
        z = [np.column_stack([self.log_odds(k, self.rows[k][p]) for k in (0, 1)]) for p in (1, 2)]
        top = _line(z[0], self.y[1])
        return _loss(z[1] @ top[:-1] + top[-1], self.y[2])

    def log_odds(self, k: int, rows: Rows) -> np.ndarray:
        return self.views[k].score(rows) * self.lines[k][0] + self.lines[k][1]

    def wanted(self) -> tuple[int, int]:
        """How many rows of label 0 and of label 1 a view offers in a round."""
        total, share = self.grow * len(self.y[0]), self.y[0].mean()
        return max(1, round(total * (1 - share))), max(1, round(total * share))

    def teach(self, k: int, rows: Rows, labels: np.ndarray) -> bool:
        """Let view k learn rows that the other is sure of; taken back if both views combined then know the judging part less well."""
        before, kept = self._judged(), (self.views[k], self.lines[k], self.told[k])
        self.told[k] = (_joined([self.told[k][0], rows]), np.concatenate([self.told[k][1], labels]))
        self.views[k] = self._fit(k, *self.told[k])
        self.lines[k] = self._line(k, 1)
        if self._judged() > before:
            self.views[k], self.lines[k], self.told[k] = kept
            return False
        return True

    def finish(self) -> CoTrained:
        if self.views is not None:
            self.lines = [self._line(k, 3) for k in (0, 1)]
            both = np.concatenate([self.y[1], self.y[2]])
            z = [np.concatenate([self.log_odds(k, self.rows[k][p]) for p in (1, 2)]) for k in (0, 1)]
            self.top = _line(np.column_stack(z), both)
            del self.rows, self.told, self.y
        return self

    def score(self, views: tuple[Rows, Rows]) -> list[np.ndarray]:
        if self.views is None:
            return [np.full(len(views[0]), self.share)] * 3
        z = [self.log_odds(k, v) for k, v in enumerate(views)]
        return [_sigmoid(np.column_stack(z) @ self.top[:-1] + self.top[-1]), _sigmoid(z[0]), _sigmoid(z[1])]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        texts, out = as_bytes(b.column("text")), [[], []]
        named = [b.column(c).to_pylist() for c in ("lang", "source", "n_chars")]
        for i, j in pieces(texts):
            for k, rows in enumerate(_of(texts[i:j], *[c[i:j] for c in named])):
                out[k] += [p.astype((np.uint32, np.uint16)[k]).tobytes() for p in np.split(rows.place, rows.begin[1:])]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), *[pa.array(o, pa.binary()) for o in out]], names=["doc_id", "row", "content", "metadata"])


def _views(content: list[bytes], metadata: list[bytes]) -> tuple[Rows, Rows]:
    return tuple(Rows(np.frombuffer(b"".join(x), t).astype(np.int64), np.array([len(f) // t().itemsize for f in x], np.int64)) for x, t in ((content, np.uint32), (metadata, np.uint16)))


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, row, content, metadata) of every row of docs, written once; row is a hash of the row. Missing columns count as null."""
    types = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    known = docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
    known = known.withColumn("row", F.xxhash64(*types))
    return written(known.mapInArrow(tidy(_packed), "doc_id long, row long, content binary, metadata binary"))


def _fetched(features: DataFrame, keys: DataFrame, on: str) -> dict:
    """Features by key, of a bounded table of keys; of several rows the least, so that repeated rows count once."""
    least = features.join(sized(keys), on, "left_semi").groupBy(on).agg(F.min(F.struct("content", "metadata")).alias("v"))
    return {r[0]: (bytes(r.v.content), bytes(r.v.metadata)) for r in least.collect()}


def _surest(features: DataFrame, models: dict[str, CoTrained], done: dict[tuple[str, int], np.ndarray]) -> dict[tuple[str, int, int], list[int]]:
    """(target, view, label) -> rows: those that each view is surest of among all rows but those done, surest first.

    done: (target, view) -> rows, sorted, that the view has offered; at most
    `rounds * grow` of the labelled rows.
    """
    wanted = {t: m.wanted() for t, m in models.items()}
    scorers = {t: (m.views, m.lines) for t, m in models.items()}
    kinds = [(t, k, label) for t in models for k in (0, 1) for label in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(kinds)
        for b in small(batches, 4096):
            views, rows = _views(b.column("content").to_pylist(), b.column("metadata").to_pylist()), b.column("row").to_numpy()
            z = {(t, k): m[k].score(views[k]) * lines[k][0] + lines[k][1] for t, (m, lines) in scorers.items() for k in (0, 1)}
            for i, (t, k, label) in enumerate(kinds):
                sure = z[t, k] if label else -z[t, k]
                old = done[t, k]
                told = old[np.minimum(np.searchsorted(old, rows), len(old) - 1)] == rows if len(old) else np.zeros(len(rows), bool)
                use = np.flatnonzero((sure > SURE) & ~told)
                r, s = np.concatenate([best[i][0], rows[use]]), np.concatenate([best[i][1], sure[use]])
                r, first = np.unique(r, return_index=True)
                top = np.lexsort((r, -s[first]))[: wanted[t][label]]
                best[i] = (r[top], s[first][top])
        n = [len(r) for r, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(kinds), dtype=np.int32), n)), *[pa.array(np.concatenate([x[j] for x in best])) for j in (0, 1)]], names=["kind", "row", "sure"])

    found = written(features.select("row", "content", "metadata").mapInArrow(tidy(run), "kind int, row long, sure double"))
    out = {}
    for i, kind in enumerate(kinds):
        top = found.where(F.col("kind") == i).groupBy("row").agg(F.max("sure").alias("sure")).orderBy(F.desc("sure"), "row").limit(wanted[kind[0]][kind[2]])
        out[kind] = [r["row"] for r in top.collect()]
    return out


def train(features: DataFrame, labels: DataFrame, targets: tuple[str, ...], labelled: int = LABELLED, rounds: int = ROUNDS, grow: float = GROW, watch: Callable | None = None) -> dict[str, CoTrained]:
    """A model for each label column of labels(doc_id, ...), from a table of `featured`. watch gets each round's offers."""
    y = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.min(t).alias(t) for t in targets])
    h = F.xxhash64("doc_id")
    chosen = written(y.join(features.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi").orderBy(h, "doc_id").limit(labelled))
    mine = _fetched(features, chosen.select("doc_id"), "doc_id")
    known = sorted(chosen.collect(), key=lambda r: int(mix(np.array([r.doc_id], np.int64).view(np.uint64))[0]))
    models = {}
    for t in targets:
        use = [r for r in known if r[t] is not None]
        models[t] = CoTrained(_views([mine[r.doc_id][0] for r in use], [mine[r.doc_id][1] for r in use]), np.array([float(r[t]) for r in use]), grow)
    able = {t: m for t, m in models.items() if m.views is not None}
    others = features.join(sized(chosen.select("doc_id")), "doc_id", "left_anti") if able else None
    done = {(t, k): np.zeros(0, np.int64) for t in able for k in (0, 1)}
    for _ in range(rounds if able else 0):
        offered = _surest(others, able, done)
        for (t, k, _), found in offered.items():
            done[t, k] = np.union1d(done[t, k], np.array(found, np.int64))
        if watch is not None:
            watch(offered)
        rows = sorted({r for found in offered.values() for r in found})
        if not rows:
            break
        got = _fetched(others, features.sparkSession.createDataFrame([(r,) for r in rows], "row long"), "row")
        for t, m in able.items():
            # Both views' offers are made before either learns.
            for k in (0, 1):
                pairs = [(r, label) for label in (0, 1) for r in offered[t, 1 - k, label]]
                if pairs:
                    new = _views([got[r][0] for r, _ in pairs], [got[r][1] for r, _ in pairs])[k]
                    m.teach(k, new, np.array([float(label) for _, label in pairs]))
    return {t: m.finish() for t, m in models.items()}


def scored(features: DataFrame, models: dict[str, CoTrained]) -> DataFrame:
    """doc_id and, for each target, its probability and those of the two views alone, for every row of features."""
    names = [f"{t}{part}" for t in models for part in ("", "_content", "_metadata")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 4096):
            views = _views(b.column("content").to_pylist(), b.column("metadata").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(s) for m in models.values() for s in m.score(views)]], names=["doc_id", *names])

    return features.select("doc_id", "content", "metadata").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def judged(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, quality, toxic, keep, views' scores) of every row of docs: keep is quality >= 0.5 > toxic."""
    features = featured(docs)
    out = scored(features, train(features, labels, ("quality", "toxic"), rounds=rounds))
    return out.select("doc_id", "quality", "toxic", ((F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)).alias("keep"), "quality_content", "quality_metadata", "toxic_content", "toxic_metadata")
