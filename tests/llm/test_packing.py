import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from quillspan.llm.packing import OPEN_BINS, WAVES, BestFit, WordIds, packed, tokenizer_path


def test_ids_equal_the_tokenizer():
    texts = ["Hello, WORLD! it's  don't", "", " \n", "a b\x1cc", "<|endoftext|> x<|startoftext|>", "ÉCOLE ß Ǆ Σς ΑΣ ñ ñ", "price=$3,000.00 (ok) 42abc7", "ção*** | a | b", "日本語 text", "éte", "x" * 300, "foo's're", "İstanbul"]
    plain = Tokenizer.from_file(tokenizer_path())
    enc = WordIds(tokenizer_path())
    for _ in range(2):
        assert [x.tolist() for x in enc.encode([t.encode() for t in texts])] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_cache_is_bounded(monkeypatch):
    import quillspan.llm.packing as p

    monkeypatch.setattr(p, "CACHE", 50)
    enc, plain = WordIds(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for k in range(5):
        texts = [" ".join(f"w{k}x{i}" for i in range(40)), "w0x1 again"]
        assert [x.tolist() for x in enc.encode([t.encode() for t in texts])] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_more_words_than_the_cache_after_others(monkeypatch):
    import quillspan.llm.packing as p

    monkeypatch.setattr(p, "CACHE", 50)
    enc, plain = WordIds(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for texts in (["a b c"], ["a " + " ".join(f"w{i}" for i in range(120))], ["w5 b"]):
        assert [x.tolist() for x in enc.encode([t.encode() for t in texts])] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_best_fit_rule():
    bins = BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    bins = BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 9, 3, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]


def test_packs_everything_once(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["alpha", "Beta,", "gamma's", "delta42"]) for _ in range(r.choice([0, 5, 60, 900, 5000])))) for i in range(150)]
    rows += [(7, None), (None, "x"), (7, "dup"), (7, "dup")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as sequence_id", "'p' as piece", "1L as length").repartition(3)
    out = packed(df, with_ids=True).collect()
    plain, bins = Tokenizer.from_file(tokenizer_path()), {}
    want, total = [], 0
    for d, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want.append((d, k, at, len(part), zlib.crc32(part.tobytes()), tuple(part.tolist())))
    assert sorted(map(str, want)) == sorted(str((x.doc_id, x.piece, x.start, x.length, x.ids_crc32, tuple(x.ids))) for x in out)
    for x in out:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    assert -(-total // 2048) <= len(bins) <= 1.03 * total / 2048 + 1
    assert packed(df.limit(0)).collect() == []


def test_long_text_in_stretches(monkeypatch):
    import quillspan.llm.packing as p

    monkeypatch.setattr(p, "STRETCH", 100)
    enc, plain = WordIds(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    texts = ["Some words, here. " * 60, "", "x" * 500 + " tail", " \n" * 200, "a b"]
    assert [x.tolist() for x in enc.encode([t.encode() for t in texts])] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_few_open_bins_in_waves_pack_nearly_as_well_as_all():
    """On lengths like those of documents the closing rule fires for a large part of the bins and costs little."""
    r = random.Random(3)
    lengths = [min(2048, max(1, int(r.lognormvariate(6.4, 1.1)))) for _ in range(16_384)]
    stream = [n for k in range(WAVES) for n in sorted(lengths[k::WAVES], reverse=True)]
    bins = BestFit(2048, OPEN_BINS)
    for n in stream:
        bins.place(n)
        assert bins.open <= OPEN_BINS
    assert bins.closed > bins.opened // 10
    assert bins.opened <= 1.01 * sum(lengths) / 2048


def test_rows_of_one_id_are_dealt_evenly(spark):
    """Null ids and equal rows go to all tasks alike."""
    import quillspan.llm.packing as p

    df = spark.range(4000).selectExpr("cast(null as long) as doc_id", "0 as piece", "0L as start", "700L as length", "5L as ids_crc32").repartition(3)
    out = p.pack(df, 4 * p.ROWS_PER_TASK).selectExpr("sequence_id >> 36 as task").groupBy("task").count().collect()
    assert len(out) == 4 and max(r["count"] for r in out) < 1100
