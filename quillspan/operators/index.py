"""The incremental run: diff, clean, chunk, embed, insert."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillspan.operators.chunk import chunk_files
from quillspan.operators.diff import STATUSES, diff_snapshot, files_to_clean, files_to_index
from quillspan.operators.embed import embed_chunks, hashed_words
from quillspan.operators.maintain import insert_chunks, insert_documents, insert_embeddings, remove_chunks, remove_documents
from quillspan.sources.store import Index, VectorStore, bucket_of, kept, scratch_dir


@dataclass
class Params:
    target: int = 256
    most: int = 1024
    node_source: str = "lines"
    embed_fn: Callable = hashed_words
    batch_size: int = 100
    #: Token counts of a list of texts; ceil(UTF-16 units / 4) without.
    counter: Callable | None = None
    #: Where vectors are kept by content, so that a text is embedded once whatever run it comes in.
    store: VectorStore | None = None


def index_batch(files: DataFrame, index: Index, params: Params | None = None, now: Column | None = None, partial: bool = False, scratch: str | None = None) -> Index:
    """The index after files(file_path, content, hash, language).

    Files without chunks are not recorded, so they stay new. partial: the files
    are not all there are, so documents that are missing among them stay. Of a
    stored index only the buckets of changed paths are read and made anew; the
    others go on as they are. `counts` of the result has the files by status.
    """
    params, now = params or Params(), F.current_timestamp() if now is None else now
    known = index.documents.join(files.select("file_path"), "file_path", "left_semi") if partial else index.documents
    root = scratch or scratch_dir(files.sparkSession)
    counted = Observation()
    status = diff_snapshot(files, known).observe(counted, *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    diff = kept(status, f"{root}/diff")
    clean, todo = files_to_clean(diff), files_to_index(diff)
    which = None
    if index.base is not None:  # at most as many numbers as there are buckets
        paths = diff.where("status <> 'unchanged'").select(bucket_of(F.col("file_path"), index.base.buckets).alias("b")).distinct()
        which = sorted(r["b"] for r in paths.collect())
    old = {name: index.table(name) if which is None else index.buckets(name, which) for name in ("documents", "chunks", "embeddings")}
    chunks, embeddings = remove_chunks(old["chunks"], old["embeddings"], clean)
    documents = remove_documents(old["documents"], clean)
    changed = files.join(todo, "file_path", "left_semi")
    # Chunks and vectors are written once: no text is chunked or embedded twice, whatever reads them and whichever executor is lost.
    new = kept(chunk_files(changed, params.target, params.most, params.node_source, params.counter), f"{root}/chunks")
    vectors = kept(embed_chunks(new, params.embed_fn, params.batch_size, store=params.store), f"{root}/vectors")
    with_chunks = changed.join(new.select("file_path").distinct(), "file_path", "left_semi").select("file_path", "hash")
    made = {"documents": insert_documents(documents, with_chunks, now), "chunks": insert_chunks(chunks, new, now), "embeddings": insert_embeddings(embeddings, vectors, now)}
    out = Index(**made, arrivals=index.arrivals, held=root, base=index.base, home=index.home, counts=counted.get)
    if which is not None:
        out.touched = {name: (which, rows) for name, rows in made.items()}
        rest = [b for b in range(index.base.buckets) if b not in set(which)]
        for name, rows in made.items():
            setattr(out, name, index.buckets(name, rest).unionByName(rows))
    return out
