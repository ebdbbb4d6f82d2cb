"""Best-fit packing of token sequences by bounded-space online best-fit.

Tokenizing is row-local: a text is split at ASCII white space, which this
tokenizer never crosses, and each distinct word is encoded once and kept in a
cache. Pieces (a document's tokens and a closing 0, cut only above the capacity)
are then dealt evenly to tasks, and each task packs its stream with a fixed
number of open bins, held in a bitset over free space: the best fit for a piece
is the lowest set bit at or above its length, and when all bins are open the
fullest (lowest set bit) closes.

A task's stream comes in `WAVES` waves (by a hash of the piece), each from its
longest piece to its shortest, so that the short ones of a wave fill what its
long ones leave although only `OPEN_BINS` bins are open. The number of tasks
follows the number of rows (`ROWS_PER_TASK`), so a task's work is bounded at any
size.

Null or empty texts pack as the single closing 0. Rows with equal or null doc_id
are packed each by itself and dealt out like all others. Very long texts are
tokenized in stretches of words of about `STRETCH` bytes. An empty table gives no
rows. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.arrays import Words, as_bytes, pieces, small, starts_of, tidy

CAPACITY = 2048
#: Bins open at once in a task, and the waves in which its pieces come.
OPEN_BINS, WAVES = 128, 64
ROWS_PER_TASK = 16_384
#: Distinct words whose ids a worker keeps.
CACHE = 600_000
#: Bytes of texts that are split into words at once.
STRETCH = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]").search

#: A word, a line each: one run of letters that the tokenizer takes whole, one run of other characters, without apostrophes (its contractions), and what else there is.
_PARTS = re.compile(r"([a-zß-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)(.*)\n").findall


class _Ids:
    """Token ids of numbered strings, behind one another in `flat`."""

    def __init__(self):
        self.flat, self.begin, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, length: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, len(self.flat) + starts_of(length)])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, flat])

    def of(self, which: np.ndarray) -> np.ndarray:
        """The ids of some strings, behind one another."""
        n = self.length[which]
        return self.flat[np.arange(n.sum()) + np.repeat(self.begin[which] - starts_of(n), n)]


class WordIds:
    """Token ids of texts by a word-level BPE tokenizer file, with a cache over words (by 64-bit values) and one over their parts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closing[i] = token.endswith("</w>")
        self._clear_words()
        self._clear_parts()

    def _clear_words(self) -> None:
        self.words, self.values, self.number = _Ids(), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _clear_parts(self) -> None:
        self.parts, self.part_number = _Ids(), {"": 0}
        self.parts.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _encoded(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)

    def _learn_parts(self, new: list[str]) -> None:
        """Runs that are one word each to the tokenizer: encoded together, cut at word-closing tokens."""
        for i in range(0, len(new), 4096):
            some, n = new[i : i + 4096], len(self.part_number)
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closing[ids]) + 1
            whole = len(ends) == len(some) and ends[-1] == len(ids)
            self.parts.add(*((ids, np.diff(ends, prepend=0)) if whole else self._encoded(some)))
            self.part_number.update(zip(some, range(n, n + len(some)), strict=True))

    def _learn(self, new: list[str]) -> None:
        """Ids of more words, numbered on in their order."""
        split = _PARTS("\n".join([*new, ""]).lower())
        odd = np.fromiter((bool(rest) or "<|" in marks for _, marks, rest in split), bool, len(split))
        whole = [("", "") if o else x[:2] for o, x in zip(odd.tolist(), split, strict=True)]
        if len(self.part_number) > CACHE // 2:
            self._clear_parts()
        both = [p for x in whole for p in x]
        self._learn_parts(list(set(both).difference(self.part_number)))
        numbers = np.fromiter(map(self.part_number.__getitem__, both), np.int64, len(both))
        found = [(self.parts.of(numbers), self.parts.length[numbers].reshape(-1, 2).sum(axis=1))]
        if odd.any():  # the odd words' ids come behind, and are put in by a gather
            other = _Ids()
            for flat, length in (found[0], self._encoded([new[i] for i in np.flatnonzero(odd).tolist()])):
                other.add(flat, length)
            which = np.where(odd, len(new) + np.cumsum(odd) - 1, np.arange(len(new)))
            found = [(other.of(which), other.length[which])]
        self.words.add(*found[0])

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        words = Words(texts)
        values, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        for known in (True, False):
            at = np.minimum(np.searchsorted(self.values, values), max(len(self.values) - 1, 0))
            fresh = np.flatnonzero(self.values[at] != values) if len(self.values) else np.arange(len(values))
            if not known or not len(self.values) or len(self.values) + len(fresh) <= CACHE:
                break
            self._clear_words()  # once; then all words of these texts, however many
        if len(fresh):
            raw, begin, end = words.buf.tobytes(), words.starts[first[fresh]].tolist(), words.ends[first[fresh]].tolist()
            n = len(self.values)
            self._learn([raw[i:j].decode("utf-8", "surrogatepass") for i, j in zip(begin, end, strict=True)])
            places = np.searchsorted(self.values, values[fresh])
            self.values, self.number = np.insert(self.values, places, values[fresh]), np.insert(self.number, places, np.arange(n, n + len(fresh)))
        number = self.number[np.searchsorted(self.values, values)][which]
        tokens = np.append(0, np.cumsum(self.words.length[number]))
        return np.split(self.words.of(number), tokens[words.first[1:]]) if len(texts) > 1 else [self.words.of(number)]

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text (UTF-8), in order; some at a time, so that arrays and cache are bounded, and long texts in stretches of words."""
        for i, j in pieces(texts, STRETCH):
            if len(texts[i]) > STRETCH:
                yield np.concatenate([ids for part in _stretches(texts[i]) for ids in self._group([part])])
            else:
                yield from self._group(texts[i:j])


def _stretches(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        space = _SPACE(text, at + STRETCH)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


_encoders: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pieces(docs: DataFrame, path: Callable[[], str] = tokenizer_path, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of docs(doc_id, text). `path` is called where the tokenizer is loaded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path())
        for b in small(batches):
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            for d, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(as_bytes(b.column("text"))), strict=True):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int64))
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int64()))] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


class BestFit:
    """Online best-fit over a bounded number of open bins.

    Bit f of `levels` is set where an open bin has f free places; `stacks[f]`
    holds those bins. A bin that fills up closes itself; `closed` counts those
    that had to make room.
    """

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.levels, self.open, self.opened, self.closed = 0, 0, 0, 0
        self.stacks: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        bin_id = stack.pop()
        if not stack:
            self.levels ^= 1 << free
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next piece."""
        fits = self.levels >> length
        if fits:
            free = length + ((fits & -fits).bit_length() - 1)
            bin_id = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.levels & -self.levels).bit_length() - 1)  # the fullest closes
                self.closed += 1
            bin_id, free = self.opened, self.capacity
            self.opened += 1
        if left := free - length:
            self.stacks.setdefault(left, []).append(bin_id)
            self.levels |= 1 << left
            self.open += 1
        return bin_id, self.capacity - free


def pack(pieces: DataFrame, rows: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """pieces(doc_id, piece, length, ids_crc32, ...) with sequence_id and offset; `rows` (about as many as pieces) sets the number of tasks."""
    schema = pieces.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 36
        for b in batches:
            placed = [bins.place(n) for n in b.column("length").to_pylist()]
            extra = [pa.array([base + p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "sequence_id", "offset"])

    tasks = max(1, -(-rows // ROWS_PER_TASK))
    wave = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(WAVES))
    dealt = pieces.repartition(tasks).sortWithinPartitions(wave, F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(tidy(run), f"{schema},sequence_id:bigint,offset:bigint")


def packed(docs: DataFrame, path: Callable[[], str] = tokenizer_path, with_ids: bool = False) -> DataFrame:
    """The pieces of docs(doc_id, text) and their places."""
    return pack(cut_pieces(docs, path, with_ids=with_ids), docs.count())
