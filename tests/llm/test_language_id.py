import random
import zlib

import pytest

from quillspan.llm.language_id import languages

WORDS = {"xa": "tion ing the er and", "xb": "keit ung der sch und", "xc": "ción que los ar el"}


def corpus():
    r = random.Random(4)
    rows = []
    for i in range(360):
        lang = r.choice(list(WORDS))
        parts = WORDS[lang].split()
        text = " ".join("".join(r.choice(parts) for _ in range(r.choice([1, 2, 3]))) for _ in range(r.choice([4, 30, 200])))
        rows.append((i, text.upper() if i % 9 == 0 else text, lang if i % 17 else None, lang))
    return rows


def test_accuracy_and_contract(spark):
    rows = corpus()
    odd = [(1000, None, "xa"), (1001, "", "xa"), (1002, "12 !! ,", "xb"), (1003, "x", None), (None, "tion ing the", "xa"), (5, rows[5][1], "xa")]
    df = spark.createDataFrame([r[:3] for r in rows] + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as held_out").repartition(3)
    out = languages(df).collect()
    assert len(out) == len(rows) + len(odd)
    truth = {r[0]: r[3] for r in rows}
    held = [x for x in out if x.held_out and x.doc_id in truth]
    assert held and sum(x.lang_pred == truth[x.doc_id] for x in held) / len(held) > 0.97
    for x in out:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
        assert 0 <= x.score <= 1
    assert {x.lang_pred for x in out if x.doc_id in (1000, 1001, 1002)} == {"und"}
    assert len({(x.lang_pred, x.score) for x in out if x.doc_id == 5}) == 1


def test_held_out_labels_do_not_matter(spark):
    rows = corpus()
    def run(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
        return sorted((x.doc_id, x.lang_pred, round(x.score, 9)) for x in languages(df).collect())
    other = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 3 == 1 else lang) for d, t, lang, _ in rows]
    assert run([r[:3] for r in rows]) == run(other)


@pytest.mark.parametrize("rows", [[], [(1, "abc", None), (2, None, None)]])
def test_nothing_to_learn(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [(x.lang_pred, x.score) for x in languages(df).collect()] == [("und", 0.0)] * len(rows)


def test_very_long_and_repeated_rows(spark):
    """A text of a million characters is scored whole; a row repeated very often counts once in training."""
    rows = [r[:3] for r in corpus()] + [(7000, "ción que los ar el " * 60_000, None)] + [(3, "tion ing the er and", "xa")] * 3000
    out = {x.doc_id: x for x in languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert out[7000].lang_pred == "xc" and len(out) == 361
    held = [(x.lang_pred, r[3]) for r in corpus() if (x := out[r[0]]).held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
