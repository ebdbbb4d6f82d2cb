"""Embedding of chunks in batches with a function of the caller's."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.sources.store import VectorStore

WIDTH = 64


def hashed_words(texts: list[str], width: int = WIDTH) -> list[list[float]]:
    """A stand-in that needs no network: words counted in places by their md5, at unit length (zero for no words)."""
    out = np.zeros((len(texts), width))
    places: dict[str, int] = {}
    for row, t in zip(out, texts, strict=True):
        for w in t.split():
            if w not in places:
                places[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % width
            row[places[w]] += 1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)).tolist()


def _keyed(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "content", F.sha2("content", 256).alias("h"))


def embed_texts(texts: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]], batch_size: int = 100, parallel: int | None = None) -> DataFrame:
    """(h, embedding) of texts(h, content), in lists of up to batch_size."""
    texts = texts.repartition(parallel) if parallel else texts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"h": [], "content": []})
        for b in batches:
            held = pd.concat([held, b], ignore_index=True)
            while len(held) >= batch_size:
                yield of(held[:batch_size])
                held = held[batch_size:].reset_index(drop=True)
        if len(held):
            yield of(held)

    def of(some: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"h": some["h"].tolist(), "embedding": embed_fn(some["content"].tolist())})

    return texts.select("h", "content").mapInPandas(run, "h string, embedding array<float>")


def embed_chunks(chunks: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]] = hashed_words, batch_size: int = 100, parallel: int | None = None, store: VectorStore | None = None) -> DataFrame:
    """(chunk_id, embedding) of chunks(id, content): embed_fn gets lists of up to batch_size texts, and equal texts are sent once.

    parallel sets how many calls run at a time. store: texts that it knows are not
    sent, and the others' vectors are in it before anything else reads them.
    """
    keyed = _keyed(chunks)
    texts = keyed.groupBy("h").agg(F.min("content").alias("content"))
    if store is None:
        vectors = embed_texts(texts, embed_fn, batch_size, parallel)
    else:
        # Hashes alone are compared; of the store's vectors only the ones asked for are joined.
        store.add(embed_texts(texts.join(store.vectors().select("h"), "h", "left_anti"), embed_fn, batch_size, parallel))
        vectors = store.vectors().join(keyed.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.first("embedding").alias("embedding"))
    return keyed.select("id", "h").join(vectors, "h").select(F.col("id").alias("chunk_id"), "embedding")
