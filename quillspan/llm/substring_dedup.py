"""Substring dedup by difference-cover anchors.

A word goes when a window of 13 consecutive words covers it and the same window
also starts in a document with a smaller doc_id. Instead of all windows, the
first pass hashes runs of 7 words at the positions whose residue modulo 7 is in
the difference cover {1, 2, 4}: for any two positions there is an offset below 7
at which both residues are in the cover, so two equal windows of 13 words always
share an aligned anchor (offset + 7 <= 13). Anchors found in one document only
rule their windows out; the second pass extends the others to the windows around
them and looks up each window's smallest document exactly.

Both passes send hashes to buckets and get back which of them matter (`_ask`).
A batch of documents sends a value once however often it has it, so a passage
that a third of all documents share costs a bucket one entry a batch. No text is
shuffled as long as what is found fits a broadcast; beyond that, the texts are
joined with it by a shuffle.

Null and empty texts have no words. Rows with a null doc_id neither lose words
nor make others lose them, since null is not smaller than anything. Rows with
one doc_id are treated each by itself, equal rows alike. A phrase that one text
repeats thousands of times is one value with many places. Very long texts are
whole: their values leave in several batches. An empty table gives no rows.
Columns beside doc_id and text are not read. 64-bit values stand for windows. The
number of buckets follows the bytes of all texts, so that a bucket stays small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.arrays import Words, as_bytes, pieces, runs_of, sized, small, starts_of, tidy, written

WINDOW, PERIOD, COVER = 13, 7, np.array([1, 2, 4])
ANCHOR = WINDOW - PERIOD + 1
#: Values of one batch of documents that go out together.
ITEMS = 1 << 19
#: Bytes of text whose values may meet in one bucket, which a task holds at once.
BUCKET_BYTES = 64 << 20

_SENT = "bucket int, uid long, kind int, hashes binary, at binary, docs binary, texts binary, counts binary"
_NAMES = [x.split()[0] for x in _SENT.split(", ")]


def _anchor_places(n: int) -> np.ndarray:
    """Word positions of a text's anchors."""
    if n < WINDOW:
        return np.zeros(0, np.int64)
    p = (np.arange(0, n, PERIOD)[:, None] + COVER).ravel()
    return p[p <= n - ANCHOR]


def _anchors(words: Words, _: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places in the text, texts) of the anchors."""
    all_runs = runs_of(words.hashes, ANCHOR)
    places = [_anchor_places(int(c)) for c in words.counts]
    each = [len(p) for p in places]
    at = np.concatenate([*places, np.zeros(0, np.int64)])
    return all_runs[at + np.repeat(words.first, each)], at, np.repeat(np.arange(len(each)), each)


def _windows(words: Words, marks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places, texts) of the windows that hold a marked anchor."""
    all_runs, places = runs_of(words.hashes, WINDOW), []
    for c, m in zip(words.counts.tolist(), marks, strict=True):
        spans = np.frombuffer(m or b"", np.uint32).reshape(-1, 2).tolist()
        near = [np.arange(max(0, i - PERIOD + 1), min(j, c - WINDOW) + 1) for i, j in spans]
        places.append(np.unique(np.concatenate([*near, np.zeros(0, np.int64)])))
    each = [len(p) for p in places]
    at = np.concatenate([*places, np.zeros(0, np.int64)])
    return all_runs[at + np.repeat(words.first, each)], at, np.repeat(np.arange(len(each)), each)


def _slim(x: np.ndarray) -> bytes:
    """Differences, byte place by byte place: what changes little takes little room once the shuffle compresses it."""
    return np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _full(b: bytes, kind: type) -> np.ndarray:
    bytes_of = np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T
    return np.cumsum(np.ascontiguousarray(bytes_of).view(kind).ravel(), dtype=kind)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=_NAMES)


def _ask(docs: DataFrame, values: Callable, least: bool, buckets: int) -> DataFrame:
    """(doc_id, text_id, places): where docs(doc_id, text_id, text[, marks]) hold a value that matters.

    least: a value matters where a smaller doc_id also has it, and else where any
    other document has it.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 4096):
            texts, ids, tids = as_bytes(b.column("text")), b.column("doc_id").to_numpy(), b.column("text_id").to_numpy()
            marks = b.column("marks").to_pylist() if "marks" in b.schema.names else [None] * len(texts)
            got, count = [], 0
            for i, j in pieces(texts):
                h, at, doc = values(Words(texts[i:j]), marks[i:j])
                got.append((h, at, doc + i))
                count += len(h)
                if count >= ITEMS:
                    yield from out(got, ids, tids)
                    got, count = [], 0
            yield from out(got, ids, tids)

    def out(got, ids, tids) -> Iterator[pa.RecordBatch]:
        if not got:
            return
        h, at, doc = (np.concatenate(x) for x in zip(*got, strict=True))
        if not len(h):
            return
        order = np.lexsort((ids[doc], h))
        cut = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        run = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(h))))
        low, owner = ids[doc[order[cut]]], ids[doc[order]]
        if least:
            known = owner > low[run]
            answer = owner == low[run]  # these wait for what other batches have
        else:
            many = np.zeros(len(cut), bool)
            np.logical_or.at(many, run, owner != low[run])
            known, answer = many[run], ~many[run]
        digest = hashlib.blake2b(digest_size=8)  # of all that the batch's table is made of, order included: equal ids are equal tables
        for x in (h, at, ids[doc], tids[doc]):
            digest.update(np.ascontiguousarray(x).tobytes())
        uid = int.from_bytes(digest.digest(), "little", signed=True)
        used, small = np.unique(doc, return_inverse=True)
        counts = np.bincount(small).astype(np.uint32)
        yield _rows([(int(uid % buckets), uid, 0, _slim(np.sort(order[known]).astype(np.uint32)), _slim(at.astype(np.uint32)), ids[used].tobytes(), tids[used].tobytes(), counts.tobytes())])
        # One entry a value: its hash, the smallest document, and the places that wait for the answer.
        waiting = np.flatnonzero(answer)
        waits = np.bincount(run[waiting], minlength=len(cut)).astype(np.uint32)
        bucket = (h[order[cut]] % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((order[cut], bucket))
        present, begins = np.unique(bucket[by], return_index=True)
        first = starts_of(waits.astype(np.int64)) if len(waits) else np.zeros(0, np.int64)
        rows = []
        for k, mine in zip(present.tolist(), np.split(by, begins[1:]), strict=True):
            w = waits[mine].astype(np.int64)
            inside = np.arange(w.sum()) - np.repeat(starts_of(w), w)
            idx = order[waiting[np.repeat(first[mine], w) + inside]]
            hashes = (h[order[cut[mine]]] // np.uint64(buckets)).astype(np.uint64)
            rows.append((k, uid, 1, hashes.tobytes() if least else hashes.astype(np.uint32).tobytes(), _slim(idx.astype(np.uint32)), _slim(low[mine]) if least else None, None, w.astype(np.uint32).tobytes()))
            if len(rows) == 256:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in _NAMES), strict=True):
                if row[2] == 0:  # a batch's own table goes on as it is
                    yield _rows([row])
                    continue
                if row[0] != bucket:
                    yield _rows(answers(held))
                    bucket, held = row[0], []
                held.append(row)
        yield _rows(answers(held))

    def answers(held) -> list[tuple]:
        if len(held) < 2:
            return []
        h = np.concatenate([np.frombuffer(r[3], np.uint64 if least else np.uint32) for r in held])
        each = [len(r[3]) // (8 if least else 4) for r in held]
        order = np.argsort(h, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        run = np.empty(len(h), np.int64)
        size = np.diff(np.append(cut, len(h)))
        run[order] = np.repeat(np.arange(len(cut)), size)
        if least:
            doc = np.concatenate([_full(r[5], np.int64) for r in held])
            hit = doc > np.minimum.reduceat(doc[order], cut)[run]
        else:
            hit = size[run] > 1
        found, begin = [], 0
        for r, e in zip(held, each, strict=True):
            w = np.frombuffer(r[7], np.uint32).astype(np.int64)
            yes = np.repeat(hit[begin : begin + e], w)
            if yes.any():
                found.append((r[0], r[1], 1, _slim(_full(r[4], np.uint32)[yes]), None, None, None, None))
            begin += e
        return found

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, own, marked = None, None, []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in _NAMES), strict=True):
                if row[1] != uid:
                    yield told(own, marked)
                    uid, own, marked = row[1], None, []
                if row[2] == 0:
                    if own is not None and own[3:] != row[3:]:
                        raise ValueError(f"two batches have the id {row[1]}")
                    own = row
                marked.append(row[3])
        yield told(own, marked)

    def told(own, marked) -> pa.RecordBatch:
        docs, tids, out = [], [], []
        if own is not None and any(marked):
            idx = np.unique(np.concatenate([_full(m, np.uint32) for m in marked]))
            ids, texts, counts = np.frombuffer(own[5], np.int64), np.frombuffer(own[6], np.int64), np.frombuffer(own[7], np.uint32)
            at, ends = _full(own[4], np.uint32), np.cumsum(counts)
            who = np.searchsorted(ends, idx, side="right")
            cut = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(who)], strict=True):
                docs.append(int(ids[who[i]]))
                tids.append(int(texts[who[i]]))
                out.append(at[idx[i:j]].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "text_id", "places"])

    sent = docs.mapInArrow(tidy(send), _SENT)
    replied = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(resolve), _SENT)
    found = replied.repartition("uid").sortWithinPartitions("uid").mapInArrow(tidy(read), "doc_id long, text_id long, places binary")
    # A text's values may have left in several batches; equal rows tell the same.
    told_of = found.groupBy("doc_id", "text_id").agg(F.collect_set("places").alias("marks"))
    return told_of.mapInArrow(partial(_spans, gap=1 if least else PERIOD), "doc_id long, text_id long, marks binary")


def _spans(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    """Places as (first, last) pairs, where steps of at most `gap` go on.

    Windows start up to 6 words before an anchor they hold, so for anchors steps
    of 7 leave no other window between.
    """
    for b in batches:
        made = []
        for m in b.column("marks").to_pylist():
            at = np.unique(np.frombuffer(b"".join(m), np.uint32))
            cut = np.flatnonzero(np.diff(at) > gap)
            made.append(np.stack([at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]], axis=1).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_id"), pa.array(made, pa.binary())], names=["doc_id", "text_id", "marks"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, marks): uint32 pairs of the first and last start of the windows to remove, for the texts that have any."""
    docs = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    shared = written(_ask(docs, _anchors, False, buckets))
    near = docs.join(sized(shared), ["doc_id", "text_id"]).select("doc_id", "text_id", "text", "marks")
    return written(_ask(near, _windows, True, buckets))


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]): one row per row of docs(doc_id, text).

    kept_text is the words that stay, joined by one space.
    """
    marks = repeated_spans(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts, n, removed, sha, kept = as_bytes(b.column("text")), [], [], [], []
            for t, m in zip(texts, b.column("marks").to_pylist(), strict=True):
                words = t.split()  # bytes: ASCII white space only
                n.append(len(words))
                if m:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for first, last in np.frombuffer(m, np.uint32).reshape(-1, 2).tolist():
                        gone[first] += 1
                        gone[last + WINDOW] -= 1
                    words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary()).cast(pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    docs = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    joined = docs.join(sized(marks), ["doc_id", "text_id"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(tidy(keep), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
