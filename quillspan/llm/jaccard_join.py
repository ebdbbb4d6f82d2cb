"""N-gram Jaccard join: classes of documents whose shingle sets are near equal.

Documents link when 100 * |A & B| >= 80 * |A | B| over their distinct five-word
shingles. The join is exact (no link between different sets is lost), and its
steps are

1. *sets*: a set's 64-bit digest (`sid`) stands for all documents that have it,
   so exact copies, however many, are one node from here on;
2. *postings*: the shortest prefix of a set that any linked set must share a
   shingle with, in an order that puts the corpus's common shingles last. A
   shingle's postings are sorted by set size, so a run of them is a tile whose
   size bands (sizes within a factor of 0.8) are contiguous;
3. *stars*: in each band of a tile, the first set against the others. Hashed
   parity bitmaps bound the overlap from above by bit counts
   (|A ^ B| >= bits that differ), and the exact intersection of sorted arrays
   decides. Sets linked so far form components;
4. *tiles*: only where a tile still holds several components, the pairs of sets
   of different components within a band, block by block by bit counts, again
   with the exact intersection after it: first each set's closest in another
   component, then all that are still apart; then the final components.

Skew: copies are one node, a large group of near copies is one component after
the stars, common shingles come last in every prefix, a tile that still holds
many sets is dealt out as cells (pairs of blocks), and the tests of one
much-linked set by a salt. `connected` never gathers a group.

Nulls and empty texts have the empty set and link with nothing. Rows that share
a doc_id are separate rows with one id; rows with a null doc_id link like others
and give their class no id. A very long text is one set like others; it
is hashed whole. An empty table gives no rows. Columns beside doc_id and text are
not read, whatever their names. 64-bit values stand for shingles and
sets; two different ones coincide with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.arrays import as_bytes, connected, let_go, mix, pieces, shingle_sets, sized, small, tidy, written

#: Shingles seen in this many of the documents that a task counts together (so many values or more) are reported as common; so many of them are kept for ordering.
COMMON_IN_TASK, COUNTED, COMMON_KEPT = 3, 1 << 20, 1 << 16
#: Members of a tile that are held at once.
TILE = 2048
#: Rounds in which sets are tested against their closest in other components, before all that is left.
CLOSEST_ROUNDS = 1
#: Members of a tile that make a block; a tile with more is compared block pair by block pair, each a group of its own.
SIDE = 512
#: Exact tests of one set that one group holds.
TESTS = 512


def _digest(values: np.ndarray) -> int:
    return int((mix(values * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(values)))).sum(dtype=np.uint64).astype(np.int64)) if len(values) else 0


def bitmap(values: np.ndarray) -> np.ndarray:
    """Parity bitmap: bit i tells whether an odd number of the set's values fall on i. Four bits a value or more, a power of two from 128."""
    bits = max(128, 1 << int(4 * len(values) - 1).bit_length())
    odd = np.bincount((mix(values) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) at a smaller width: halves of a parity bitmap, taken together by exclusive or, are the narrower bitmap.

    Positions are value mod bits, so the narrower map is the XOR of the wide map's equal slices.
    """
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m that differ in at least so many elements can reach the threshold."""
    most = (n + m - differ) // 2
    return 100 * most >= 80 * (n + m - most)


def _prefix(values: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    n = len(values)
    take = n - (4 * n + 4) // 5 + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[at] == values
        if hit.any():
            rare, often = values[~hit], values[hit]
            return np.concatenate([rare, often[np.argsort(rank[at[hit]], kind="stable")]])[:take]
    return values[:take]


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sid, common, text_id): a row per document; rows with `common` report shingles frequent in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        distinct: dict[int, np.ndarray] = {}

        def count() -> None:
            v, c = np.unique(np.concatenate([*distinct.values(), np.zeros(0, np.uint64)]), return_counts=True)
            for x, y in zip(v[c >= COMMON_IN_TASK].tolist(), c[c >= COMMON_IN_TASK].tolist(), strict=True):
                seen[x] = seen.get(x, 0) + y
            distinct.clear()

        for b in small(batches):
            texts = as_bytes(b.column("text"))
            sets = [s for i, j in pieces(texts) for s in shingle_sets(texts[i:j])]
            distinct.update((_digest(s), s) for s in sets)
            if sum(map(len, distinct.values())) > COUNTED:
                count()
            n = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array([_digest(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(len(n), pa.int64()), b.column("text_id")], names=["doc_id", "n", "sid", "common", "text_id"])
            if len(seen) > COMMON_KEPT:
                yield _common(seen)
                seen.clear()
        count()
        yield _common(seen)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_id")).mapInArrow(tidy(run), "doc_id long, n long, sid long, common long, text_id long")


def _common(seen: dict[int, int]) -> pa.RecordBatch:
    none = pa.nulls(len(seen), pa.int64())
    return pa.RecordBatch.from_arrays([none, pa.array(list(seen.values()), pa.int64()), none, pa.array(np.array(list(seen), np.uint64).view(np.int64)), none], names=["doc_id", "n", "sid", "common", "text_id"])


def _tiles(docs: DataFrame, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(tile, sids, sizes): the distinct runs of two or more sets that share a prefix shingle, by size; long runs in blocks."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in small(batches):
            texts = as_bytes(b.column("text"))
            for i, j in pieces(texts):
                keys, sids, sizes = [np.zeros(0, np.uint64)], [], []
                for s in shingle_sets(texts[i:j]):
                    if len(s) > 3 and (sid := _digest(s)) not in done:  # smaller sets link with equal ones only
                        done.add(sid)
                        keys.append(_prefix(s, common, rank))
                        sids.append(sid)
                        sizes.append(len(s))
                each = [len(k) for k in keys[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(sids, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int32), each))], names=["key", "sid", "n"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sid, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        part = 0  # blocks that the first run held here has already left

        def emit(key, sid, n, part):
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            ends, out = np.append(cut[1:], len(key)) if len(cut) else cut, []
            for i, j in zip(cut[ends - cut > 1].tolist(), ends[ends - cut > 1].tolist(), strict=True):
                first = np.sort(np.unique(sid[i:j], return_index=True)[1])
                s, z, block = sid[i:j][first], n[i:j][first], part if i == 0 else 0
                if len(s) > 1:
                    out.append((int(key[i]) if block else _digest(np.sort(s).view(np.uint64)), block, s.tobytes(), z.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["tile", "block", "sids", "sizes"])

        for b in batches:
            key, sid, n = (np.concatenate([x, b.column(c).to_numpy()]) for x, c in ((key, "key"), (sid, "sid"), (n, "n")))
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # its run may go on
            if last:
                yield emit(key[:last], sid[:last], n[:last], part)
                key, sid, n, part = key[last:], sid[last:], n[last:], 0
            while len(key) > 2 * TILE:  # a long run leaves in blocks that each repeat its first set
                part += 1
                yield emit(key[:TILE], sid[:TILE], n[:TILE], part)
                key, sid, n = (np.concatenate([x[:1], x[TILE:]]) for x in (key, sid, n))
            part += part > 0
        yield emit(key, sid, n, part)

    keyed = docs.select("doc_id", "text").mapInArrow(tidy(post), "key long, sid long, n int")
    return keyed.repartition("key").sortWithinPartitions("key", "n", "sid").mapInArrow(tidy(runs), "tile long, block int, sids binary, sizes binary").dropDuplicates(["tile", "block"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each size band's first set with the band's others."""
    for b in batches:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, z in zip(b.column("sids").to_pylist(), b.column("sizes").to_pylist(), strict=True):
            s, z = np.frombuffer(s, np.int64), np.frombuffer(z, np.int32).astype(np.int64)
            i = 0
            while i < len(s) - 1:
                j = int(np.searchsorted(z, 100 * z[i] // 80, side="right"))
                right.append(s[i + 1 : j])
                left.append(np.full(len(right[-1]), s[i]))
                i = max(j, i + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def _bit_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches, 2 * TILE):
        n, m = b.column("n").to_numpy(), b.column("m").to_numpy()
        keep = np.zeros(len(n), bool)
        x, y = b.column("bits").to_pylist(), b.column("bits2").to_pylist()
        widths = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
        for w in np.unique(widths, axis=0):
            at = np.flatnonzero((widths == w).all(axis=1))
            p, q = (np.frombuffer(b"".join(v[i] for i in at), np.uint64).reshape(len(at), -1) for v in (x, y))
            least = int(w.min()) // 8
            keep[at] = may_link(n[at], m[at], np.bitwise_count(folded(p, least) ^ folded(q, least)).sum(axis=1, dtype=np.int64))
        yield b.select(["a", "b"]).filter(pa.array(keep))


def _cells(rooted: DataFrame) -> DataFrame:
    """(tile, side, sid, root) of rooted(tile, sid, root): the tiles of several components, large ones as cells.

    A tile's sets fall into blocks of about `SIDE` by a hash, and each pair of
    blocks is a cell, so that no task has to compare a whole tile. `side` is a
    set's block where two blocks meet, whose pairs within one side are another
    cell's, and -1 where a block meets itself.
    """
    tiles = rooted.groupBy("tile").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.expr(f"1 + (count(1) - 1) div {SIDE}").alias("blocks")).where("low < high")
    own = rooted.join(tiles.select("tile", "blocks"), "tile").withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "sid"), "blocks"))
    met = own.withColumn("met", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return met.select(F.xxhash64("tile", F.least("own", "met"), F.greatest("own", "met")).alias("tile"), F.expr("if(own = met, -1L, own)").alias("side"), "sid", "root")


def _tile_pairs(batches: Iterator[pa.RecordBatch], closest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of different components within a band of a cell that the bit counts let through, stretch against stretch.

    Rows come by cell and size; a stretch meets itself and the later ones whose
    sizes its own can still link with, so what is held is bounded by that band.
    closest: of a set's pairs with a stretch, only that of fewest differing bits,
    so that components at least double at little cost before the rest.
    """
    tile, held = None, []
    batches = small(batches, 2 * TILE)

    def against(x, y):
        (s, n, root, side, bits), (s2, n2, root2, side2, bits2) = x, y
        w = min(bits.shape[1], bits2.shape[1])
        p, q = folded(bits, w), folded(bits2, w)
        out = [np.zeros((2, 0), np.int64)]
        for i in range(len(s)):
            j = np.flatnonzero((root2 != root[i]) & ((side2 != side[i]) | (side[i] < 0)))
            j = j[100 * np.minimum(n[i], n2[j]) >= 80 * np.maximum(n[i], n2[j])]
            differ = np.bitwise_count(p[i] ^ q[j]).sum(axis=1, dtype=np.int64)
            may = may_link(n[i], n2[j], differ)
            j, differ = j[may], differ[may]
            if closest:
                j = j[differ.argsort(kind="stable")[:1]]
            out.append(np.stack([np.full(len(j), s[i]), s2[j]]))
        return np.concatenate(out, axis=1)

    for b in batches:
        t, n = b.column("tile").to_numpy(), b.column("n").to_numpy()
        s, root, side, bits = b.column("sid").to_numpy(), b.column("root").to_numpy(), b.column("side").to_numpy(), b.column("bits").to_pylist()
        width = np.array([len(x) for x in bits], np.int64)
        cut = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (width[1:] != width[:-1])])).tolist() if len(t) else []
        cut = sorted({*cut, *range(0, len(t), TILE)}) + [len(t)]
        found = [np.zeros((2, 0), np.int64)]
        for i, j in zip(cut, cut[1:], strict=False):
            block = (s[i:j], n[i:j], root[i:j], side[i:j], np.frombuffer(b"".join(bits[i:j]), np.uint64).reshape(j - i, -1))
            if t[i] != tile:
                tile, held = t[i], []
            held = [h for h in held if 100 * h[1][-1] >= 80 * n[i]] + [block]
            found += [against(block, h) for h in held]
        a, c = np.concatenate(found, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], names=["a", "b"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among pairs: rows of a test group come with the group's own set first."""
    a, mine = None, np.zeros(0, np.uint64)
    for b in small(batches):
        out = []
        for x, y, values in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("set").to_pylist(), strict=True):
            values = np.frombuffer(values, np.uint64)
            if y is None:
                a, mine = x, values
            elif a == x:
                at = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
                both = int((mine[at] == values).sum())
                if 100 * both >= 80 * (len(mine) + len(values) - both):
                    out.append((x, y))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["x", "y"])


def _with_sets(docs: DataFrame, owners: DataFrame, kind: str) -> DataFrame:
    """(sid, n, bits or set) of the rows named in owners(doc_id, text_id, sid): the id and the text together, as an id may have many texts, and a text many ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts, want = as_bytes(b.column("text")), b.column("sid").to_numpy()
            for i, j in pieces(texts):
                sets = shingle_sets(texts[i:j])
                same = [k for k, s in enumerate(sets) if len(s) and _digest(s) == want[i + k]]
                made = [(sets[k] if kind == "set" else bitmap(sets[k])).tobytes() for k in same]
                yield pa.RecordBatch.from_arrays([pa.array(want[i:j][same]), pa.array(np.array([len(sets[k]) for k in same], np.int64)), pa.array(made, pa.binary())], names=["sid", "n", kind])

    named = owners.select(F.col("doc_id").alias("__d"), F.col("text_id").alias("__x"), "sid")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_id")).join(sized(named), F.expr("text_id = __x and doc_id <=> __d"))
    return rows.select("sid", "text").mapInArrow(tidy(run), f"sid long, n long, {kind} binary").dropDuplicates(["sid"])


def _links(docs: DataFrame, owners: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that do link, by exact intersection; each set is sent once to each group that tests it."""
    salted = pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("tests")), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.expr(f"1 + tests div {TESTS}")).alias("salt"))
    salted = written(salted)
    named = written(salted.select(F.col("a").alias("sid")).union(salted.select("b")).distinct())
    sets = _with_sets(docs, owners.join(named, "sid", "left_semi"), "set")
    ask = salted.select("a", "salt", "b", F.col("b").alias("sid")).union(salted.select("a", "salt", F.lit(None).cast("long"), F.col("a")).distinct())
    rows = ask.join(sets.select("sid", "set"), "sid").select("a", "salt", "b", "set")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(tidy(_exact), "x long, y long").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, sid, root, text_id): one row per row of docs(doc_id, text).

    component_id is the smallest doc_id reachable by links, itself included (null
    only where no id is known); n_links counts the links found between the row's
    set and other sets, which suffice for the classes but need not be all. sid is
    the set's digest, root one of its class (both null for the empty set), text_id
    xxhash64 of the text.
    """
    found = written(_sets(docs))
    sets = found.where("common is null").select("doc_id", "n", "sid", "text_id")
    top = found.where("common is not null").groupBy("common").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "common").limit(COMMON_KEPT).toArrow()
    common = top.column("common").to_numpy().view(np.uint64)
    order = np.argsort(common)
    common, rank = common[order], top.column("c").to_numpy()[order]

    # A set's smallest row by id, null last; sets are linked by sid, whether an id is known or not.
    first = F.min(F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "text_id")).alias("o")
    owners = written(sets.where("sid is not null").groupBy("sid").agg(first).select("o.doc_id", "o.text_id", "sid"))
    spark = docs.sparkSession
    tiles = written(_tiles(docs, common, rank))
    let_go(spark)  # of the postings' shuffle; and so after each of the steps below
    named = tiles.mapInArrow(_members, "tile long, sid long").select("sid").distinct()
    named = written(named)
    bits = written(_with_sets(docs, owners.join(named, "sid", "left_semi"), "bits"))
    let_go(spark)

    other = bits.toDF("b", "m", "bits2")
    stars = tiles.mapInArrow(_stars, "a long, b long").distinct().join(bits.withColumnRenamed("sid", "a"), "a").join(other, "b")
    pairs = written(stars.select("a", "b", "n", "m", "bits", "bits2").mapInArrow(tidy(_bit_bound), "a long, b long"))
    del stars
    let_go(spark)
    links = written(_links(docs, owners, pairs))
    let_go(spark)
    roots = connected(links)

    members = tiles.where("length(sids) > 16").mapInArrow(_members, "tile long, sid long")
    for step in (partial(_tile_pairs, closest=True),) * CLOSEST_ROUNDS + (partial(_tile_pairs, closest=False),):
        rooted = members.join(roots.toDF("sid", "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        rest = _cells(rooted).join(bits, "sid").select("tile", "side", "sid", "root", "n", "bits")
        pairs = written(rest.repartition("tile").sortWithinPartitions("tile", "n", "sid").mapInArrow(tidy(step), "a long, b long").distinct())
        del rooted, rest
        let_go(spark)
        if pairs.isEmpty():
            continue
        more = written(_links(docs, owners, pairs))
        let_go(spark)
        if not more.isEmpty():
            links = links.union(more)
            roots = connected(links)

    degree = links.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("n_links"))
    rooted = owners.join(roots.toDF("sid", "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = rooted.select("sid", "root").join(least, "root").join(degree, "sid", "left").select("sid", "component_id", "n_links", "root")
    return (
        sets.join(classes, "sid", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "sid", F.coalesce("root", "sid").alias("root"), "text_id")
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sids = [np.frombuffer(s, np.int64) for s in b.column("sids").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("tile").to_numpy(), [len(s) for s in sids])), pa.array(np.concatenate([*sids, np.zeros(0, np.int64)]))], names=["tile", "sid"])
