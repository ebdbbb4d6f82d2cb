"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks of `CHUNK` characters that overlap by `OVERLAP`, and every
chunk is pre-tokenised by itself, wherever it lies. The pattern looks only ahead
of where a match begins, so once two chunks have one boundary of pre-tokens in
common, all later ones are the same: at the first common boundary of the overlap
the earlier chunk's tokens end and the later one's begin. A chunk's own boundaries
count up to `LOOK` characters before its end, as far as what lies beyond cannot
change them. Each pre-token is then encoded by itself by the ranks, as the tiktoken
library does, and ids are decoded by concatenating their bytes.

Texts of one chunk need no stitching and are encoded where they are read. Longer
ones are cut there, equal chunks of equal texts are dropped before the shuffle that
deals the chunks to tasks, and the chunks' tokens come back to one task a text, in
order, which holds two chunks at a time (SHA-256 takes a text's bytes one after
another). Where two chunks have no common boundary (a pre-token longer than the
overlap, such as thousands of letters without a space) the text is encoded again
with chunks and overlaps `WIDER` times as large, until it is done.

Null and empty texts have no tokens. Equal texts have equal results; rows with equal
or null doc_ids are rows of their own. A text that a third of all rows have is
stitched once and joined back by its SHA-256. An empty table gives no rows. Columns
beside doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.arrays import pieces, sized, small, tidy, written

CHUNK, OVERLAP, WIDER = 32_768, 1024, 8
#: A match ends where it does whatever comes this many characters later: it looks one ahead, and a contraction has three.
LOOK = 4
#: Pre-tokens whose ids a worker keeps, and up to which length.
CACHE, CACHED_CHARS = 200_000, 64

_OUT = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """(file of ranks, pattern of pre-tokens)"""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


class Codec:
    """Pre-tokens, ids and bytes by a file of ranks."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.pre_tokens = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def _packed(self, piece: str) -> bytes:
        one = self.ranks.get(piece.encode())
        return np.array(self.encoding.encode_ordinary(piece) if one is None else [one], "<u4").tobytes()

    def encode(self, split: list[str]) -> list[bytes]:
        """The ids of each pre-token, as little-endian uint32."""
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        long = {}
        for piece in set(split).difference(known):
            (known if len(piece) <= CACHED_CHARS else long)[piece] = self._packed(piece)
        return [long[p] if p in long else known[p] for p in split] if long else [known[p] for p in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def cut(text: str, chunk: int, overlap: int) -> list[str]:
    """Overlapping chunks, none of which lies in the overlap of the one before it."""
    n = max(1, -(-(len(text) - overlap) // chunk))
    return [text[i * chunk : (i + 1) * chunk + overlap if i < n - 1 else len(text)] for i in range(n)]


def boundaries(lengths: np.ndarray, size: int, last: bool) -> np.ndarray:
    """Where pre-tokens of these lengths begin and end in a chunk, up to where what follows the chunk cannot change them."""
    at = np.concatenate([[0], np.cumsum(lengths)])
    return at if last else at[at <= size - LOOK]


class Stitched:
    """A text's tokens, taken in chunk by chunk."""

    def __init__(self, codec: Codec, keep: bool):
        self.codec, self.kept = codec, [] if keep else None
        self.n, self.ids, self.decoded = 0, hashlib.sha256(), hashlib.sha256()
        self.held, self.begin, self.ends = b"", 0, (np.zeros(0, np.int64),) * 2
        self.synced = True

    def _out(self, ids: bytes) -> None:
        self.n += len(ids) // 4
        self.ids.update(ids)
        self.decoded.update(self.codec.decode(ids))
        if self.kept is not None:
            self.kept.append(ids)

    def take(self, chunk: int, ids: bytes, heads: tuple[np.ndarray, np.ndarray], tails: tuple[np.ndarray, np.ndarray]) -> None:
        """heads, tails: (places in the text, ids before them) of the boundaries in the overlap with the chunk before, and with the next."""
        if chunk and self.synced:
            _, left, right = np.intersect1d(self.ends[0], heads[0], assume_unique=True, return_indices=True)
            self.synced = len(left) > 0
            if self.synced:
                self._out(self.held[4 * self.begin : 4 * int(self.ends[1][left[0]])])
                self.begin = int(heads[1][right[0]])
        self.held, self.ends = ids, tails

    def close(self) -> None:
        if self.synced:
            self._out(self.held[4 * self.begin :])

    def row(self) -> tuple:
        """(tokens, digests, ids and bytes if kept); nulls where chunks did not meet."""
        if not self.synced:
            return None, None, None, None, None
        ids = b"".join(self.kept) if self.kept is not None else None
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest(), ids, None if ids is None else self.codec.decode(ids)


def _places(at: np.ndarray, before: np.ndarray) -> bytes:
    return np.stack([at, before]).astype(np.int64).tobytes()


def _read(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    at, before = np.frombuffer(b, np.int64).reshape(2, -1)
    return at, before


def _stitched(texts: DataFrame, codec: Callable[[], Codec], chunk: int, overlap: int, keep: bool) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of texts(key, text); nulls where two chunks did not meet."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                parts = cut(text, chunk, overlap)
                for i in range(0, len(parts), 64):
                    some = parts[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.string()), pa.array(range(i, i + len(some)), pa.int32()), pa.array([i + j == len(parts) - 1 for j in range(len(some))]), pa.array(some, pa.string())], names=["key", "chunk", "last", "text"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for b in small(batches, 64):
            out = []
            for i, last, text in zip(b.column("chunk").to_pylist(), b.column("last").to_pylist(), b.column("text").to_pylist(), strict=True):
                split = own.pre_tokens(text)
                at = boundaries(np.fromiter(map(len, split), np.int64, len(split)), len(text), last)
                ids = own.encode(split[: len(at) - 1])
                before = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)])
                head, tail = at <= overlap, at >= chunk
                out.append((_places(at[head] + i * chunk, before[head]), _places(at[tail] + i * chunk, before[tail]), b"".join(ids)))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("chunk"), *[pa.array([o[k] for o in out], pa.binary()) for k in range(3)]], names=["key", "chunk", "heads", "tails", "ids"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key, now = codec(), None, None
        for b in small(batches, 64):
            done = []
            for k, i, heads, tails, ids in zip(*(b.column(c).to_pylist() for c in ("key", "chunk", "heads", "tails", "ids")), strict=True):
                if k != key:
                    done += told(key, now)
                    key, now = k, Stitched(own, keep)
                now.take(i, ids, _read(heads), _read(tails))
            yield rows(done)
        yield rows(told(key, now))

    def told(key: str | None, now: Stitched | None) -> list[tuple]:
        if now is None:
            return []
        now.close()
        return [(key, *now.row())]

    def rows(done: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()][: 6 if keep else 4]
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names=["key", *_OUT[1:], "ids", "decoded"][: len(types)])

    dealt = texts.mapInArrow(tidy(chunks), "key string, chunk int, last boolean, text string").dropDuplicates(["key", "chunk"])
    each = dealt.mapInArrow(tidy(tokens), "key string, chunk int, heads binary, tails binary, ids binary")
    schema = "key string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * keep
    return each.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(tidy(stitch), schema)


def _whole(texts: DataFrame, codec: Callable[[], Codec], keep: bool) -> DataFrame:
    """The same of texts(doc_id, text) of one chunk each, where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for b in small(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in pieces(texts):
                ids = [b"".join(own.encode(own.pre_tokens(t))) for t in texts[i:j]]
                raw = [own.decode(x) for x in ids]
                columns = [b.column("doc_id")[i:j], pa.array([len(x) // 4 for x in ids], pa.int64()), *[pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (ids, raw)]]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(xs, pa.binary()) for xs in (ids, raw)] * keep, names=_OUT + ["ids", "decoded"] * keep)

    return texts.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * keep)


def encoded(docs: DataFrame, ranks: Callable[[], tuple[str, str]] = vocabulary, chunk: int = CHUNK, overlap: int = OVERLAP, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]): one row per row of docs(doc_id, text).

    ids: little-endian uint32; decoded: their bytes. `ranks` gives the file of ranks
    and the pattern, and is called where they are loaded.
    """
    if not LOOK < overlap <= chunk:
        raise ValueError("an overlap is longer than what a match looks ahead, and no longer than a chunk")

    def codec() -> Codec:
        return _codec(*ranks())

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.char_length("text") > chunk + overlap, F.lit(False))
    here = _whole(docs.where(~long), codec, with_ids)
    keyed = docs.where(long).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    texts, done = keyed.select("key", "text"), None
    while True:
        found = written(_stitched(texts, codec, chunk, overlap, with_ids))
        met = found.where("n_tokens is not null")
        done = met if done is None else done.union(met)
        apart = found.where("n_tokens is null").select("key")
        if apart.isEmpty():
            break
        texts = keyed.select("key", "text").join(sized(apart), "key", "left_semi")
        chunk, overlap = chunk * WIDER, overlap * WIDER
    return here.union(keyed.select("doc_id", "key").join(sized(done), "key").select(here.columns))
