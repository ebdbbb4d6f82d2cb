import hashlib
import random

import numpy as np
import pytest

from quillspan.llm.byte_bpe import Codec, boundaries, cut, encoded, vocabulary


@pytest.fixture(scope="module")
def codec():
    return Codec(*vocabulary())


def texts():
    r = random.Random(6)
    signs = ["a", "b", "'", "'ll", "'s", " ", "  ", "\n", "\n\n", "\t", " ", " ", "é", "字", "𝔸", "7", "42", "!", "--", "🎉", "\x1c", "​", "Ünï", "<|endoftext|>", "\x00"]
    out = ["".join(r.choice(signs) for _ in range(r.choice([1, 5, 40, 300, 1500]))) for _ in range(60)]
    out += ["x" * 3000, " " * 2500, "word " + "y" * 999 + " \n" * 300, "\n" * 700 + "z", "1" * 1300 + "'re" * 400, "ab'll " * 500, " ".join(["hello"] * 700)]
    return out


def want(codec, rows):
    out = []
    for d, t in rows:
        ids = np.array(codec.encoding.encode_ordinary(t or ""), "<u4").tobytes()
        raw = (t or "").encode()
        out.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest(), ids, raw))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk,overlap,parts", [(32_768, 1024, 4), (64, 16, 3), (19, 19, 1), (40, 5, 5)])
def test_equals_the_library(spark, codec, chunk, overlap, parts):
    rows = list(enumerate(texts()))
    rows += [(500, None), (501, ""), (None, rows[0][1]), (None, rows[62][1]), *[(7, rows[60][1])] * 4, *[(600 + i, rows[65][1]) for i in range(30)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as chunk", "'x' as ids").repartition(parts)
    found = encoded(df, chunk=chunk, overlap=overlap, with_ids=True)
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4]), bytes(r[5])) for r in found.collect()), key=str) == want(codec, rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encoded(df).collect() == [] and encoded(df).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_very_long_text(spark, codec):
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdefgh ") for _ in range(9)) for _ in range(60_000)) + "q" * 50_000 + " end"
    (row,) = encoded(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert tuple(row) == want(codec, [(1, text)])[0][:4]


def test_overlap_must_hold_what_a_match_looks_ahead(spark):
    with pytest.raises(ValueError):
        encoded(spark.createDataFrame([], "doc_id long, text string"), chunk=10, overlap=4)


def test_boundaries_of_a_cut_text_are_those_of_the_whole(codec):
    """Before a chunk's last characters, boundaries do not depend on what follows it."""
    for text in texts():
        full = set(np.concatenate([[0], np.cumsum([len(p) for p in codec.pre_tokens(text)])]).tolist())
        for size in (10, 33, 100, 257):
            part = text[:size]
            assert set(boundaries(np.array([len(p) for p in codec.pre_tokens(part)]), len(part), False).tolist()) <= full
    parts = cut("abcdefghij" * 5, 20, 6)
    assert [len(p) for p in parts] == [26, 26, 10] and cut("", 20, 6) == [""] and len(cut("x" * 26, 20, 6)) == 1
