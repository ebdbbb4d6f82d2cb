"""Language identification by a string kernel.

The kernel of two texts is a blended spectrum of presence: over all character
n-grams of 1 to 4 (lower case), the number both have, over the root of the
product of how many each has. N-grams are hashed to `DIMS` places. A Nyström
approximation keeps `landmarks` training texts: with K between texts and
landmarks and M among the landmarks, one-versus-rest kernel ridge regression
solves (K'K + ridge * M) a = K'Y. Scoring is two matrix products a batch.

Training reads a bounded sample (`per_language` distinct rows of each known
language, the first by a hash of doc_id and text), only from rows with a language
whose crc32(doc_id) mod 3 is not 1. Every text is scored whole.

A null text or one without letters is `und` with score 0, as is every text where
there is nothing to learn from. Rows with a null doc_id are scored, never learned
from; their held_out is false. Equal texts get equal predictions, repeated rows
count once in training. Very long texts are scored by the presence of their n-grams
like others, a few texts at a time. An empty table gives no rows. `identified`
keeps all other columns but those named lang_pred and score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.arrays import mix, sized, small, tidy, written

DIMS, MOST_N, PER_LANGUAGE, LANDMARKS, RIDGE, SHARPNESS = 1 << 14, 4, 500, 160, 0.05, 8.0
_letter = regex.compile(r"\p{L}").search
_MUL = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def _presence(texts: list[str]) -> np.ndarray:
    """Rows of 0 and 1 (float32): which hashed n-grams a text has. Rows are few (see `_blocks`)."""
    units = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, u in zip(out, units, strict=True):
        h = np.zeros(len(u), np.uint32)
        for n in range(1, min(MOST_N, len(u)) + 1):
            h = (h[: len(u) - n + 1] ^ u[n - 1 :]) * _MUL[n - 1]
            h ^= h >> np.uint32(15)
            row[h % np.uint32(DIMS)] = 1
    return out


def _blocks(n: int, rows: int = 96) -> Iterator[tuple[int, int]]:
    for i in range(0, n, rows):
        yield i, min(n, i + rows)


def _normalized(bits: np.ndarray) -> np.ndarray:
    return bits / np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1))


def is_held_out(doc_id) -> object:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class KernelModel:
    """Landmark rows (normalized presence), regression weights and the languages in order."""

    def __init__(self, landmarks: np.ndarray, weights: np.ndarray, languages: list[str]):
        self.landmarks, self.weights, self.languages = landmarks, weights, languages

    @staticmethod
    def fit(packed: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
        """From presence bits (rows, DIMS / 8), unpacked some rows at a time."""
        names, n = sorted(set(languages)), len(packed)

        def rows(which) -> np.ndarray:
            return _normalized(np.unpackbits(packed[which], axis=1).astype(np.float32))

        marks = rows(np.unique(np.linspace(0, n - 1, min(landmarks, n)).astype(int)))
        k, m = np.concatenate([rows(slice(i, j)) @ marks.T for i, j in _blocks(n)]), marks @ marks.T
        y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in languages])
        size = np.array([languages.count(name) for name in names])
        w = 1 / size[[names.index(x) for x in languages]]  # languages count alike
        left = (k.T * w) @ k / len(names) + (ridge / len(names)) * m / n + 1e-9 * np.eye(len(m))
        return KernelModel(marks.astype(np.float32), np.linalg.solve(left.astype(float), (k.T * w) @ y / len(names)).astype(np.float32), names)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        use = [i for i, t in enumerate(texts) if t is not None and _letter(t)]
        for i, j in _blocks(len(use)):
            rows = use[i:j]
            kernel = _normalized(_presence([texts[r] for r in rows])) @ self.landmarks.T
            value = kernel @ self.weights
            e = np.exp(SHARPNESS / 2 * (value - value.max(axis=1, keepdims=True)))
            share = np.round(e / e.sum(axis=1, keepdims=True), 6)  # beyond that the place in the block shows
            best = value.argmax(axis=1)
            score[rows] = share[np.arange(len(rows)), best]
            for r, b in zip(rows, best.tolist(), strict=True):
                lang[r] = self.languages[b]
        return lang, score


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        texts, out = b.column("text").to_pylist(), []
        for i, j in _blocks(len(texts)):
            out += [x.tobytes() for x in np.packbits(_presence([t or "" for t in texts[i:j]]).astype(bool), axis=1)]
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("lang"), pa.array(out, pa.binary())], names=["h", "lang", "bits"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> KernelModel | None:
    """A model from docs(doc_id, text, lang); None where no row may be learned from. Only presence bits of the sample come to the driver."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out("doc_id"))
    known = known.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    # Each language's share of its distinct rows that gives half as many again as wanted, by a threshold for the hash; no group of rows meets.
    counts = written(known.select("lang", "h").distinct().groupBy("lang").count())
    rate = F.least(F.lit(1.0), F.lit(1.5 * per_language) / F.col("count"))
    place = (F.col("h") + F.lit(0.5)) / float(1 << 64) + F.lit(0.5)
    chosen = known.join(sized(counts), "lang").where(place < rate).groupBy("h", "lang").agg(F.min("text").alias("text"))
    rows = sorted(chosen.mapInArrow(tidy(_fingerprints), "h long, lang string, bits binary").collect(), key=lambda r: (r.h, r.lang))
    seen: dict[str, int] = {}
    kept = []
    for r in rows:
        seen[r.lang] = seen.get(r.lang, 0) + 1
        if seen[r.lang] <= per_language:
            kept.append(r)
    rows = sorted(kept, key=lambda r: (int(mix(np.array([r.h]).view(np.uint64))[0]), r.lang))
    if not rows:
        return None
    packed = np.frombuffer(b"".join(bytes(r.bits) for r in rows), np.uint8).reshape(len(rows), -1)
    return KernelModel.fit(packed, [r.lang for r in rows])


def identified(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """docs(doc_id, text, ...) with lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = b.column("text").to_pylist()
            lang, score = model.predict(texts) if model else (["und"] * len(texts), np.zeros(len(texts)))
            own = [n for n in b.schema.names if n not in ("lang_pred", "score")]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in own], pa.array(lang, pa.string()), pa.array(score)], names=[*own, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("lang_pred", "score"))
    return docs.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs(doc_id, text, lang)."""
    model = train(docs)
    return identified(docs.select("doc_id", is_held_out("doc_id").alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
