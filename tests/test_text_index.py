import random

import pytest

from quillspan.operators import lexical

SCHEMA = "id string, file_path string, start_line int, end_line int, content string"


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "été", "字字", "50%", "a_b", "x\\y"]
    rows = [(f"d{i % 9}/f{i}__{k}", f"d{i % 9}/f{i}", 10 * k, 10 * k + 9, " ".join(r.choice(words) for _ in range(30)) + (f" rare{i}" if i % 17 == 0 else "")) for i in range(120) for k in range(3)]
    return spark.createDataFrame([*rows, ("n__0", "n", 0, 1, None), ("e__0", "e", 0, 1, "")], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def index(chunks, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    lexical.build_text_index(chunks, folder, part_bytes=6000, bits=1 << 14)
    return lexical.load_text_index(chunks.sparkSession, folder, 1 << 14)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("pattern", ["rare34", "rare", "alpha beta gamma", "字字 été", "50% a_b", "x\\y", "nowhere", "ab", "", "é"])
def test_equals_the_scan(chunks, index, pattern):
    assert rows(lexical.grep_indexed(index, pattern, 1000)) == rows(lexical.grep(chunks, pattern, 1000))
    assert rows(lexical.grep_indexed(index, pattern, 3)) == rows(lexical.grep(chunks, pattern, 3))


@pytest.mark.parametrize("pattern", ["rare3_", "alpha%rare17", "été_字", "50\\%%a\\_b", "nowhere%", "%", "a_"])
def test_like_equals_the_scan(chunks, index, pattern):
    assert rows(lexical.grep_like_indexed(index, pattern, 1000)) == rows(lexical.grep_like(chunks, pattern, 1000))


def test_only_parts_that_may_have_it_are_read(index):
    parts = index.chunks.select("part").distinct().count()
    some = lexical.parts_with(index, ["rare34"])
    assert parts >= 8 and 1 <= len(some) <= 3
    plan = lexical.grep_indexed(index, "rare34")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert lexical.parts_with(index, ["nowhere"]) == [] and lexical.parts_with(index, ["ab", ""]) is None
    assert lexical.like_literals("a\\%b%cd_e%%") == ["a%b", "cd", "e"]


def test_empty(spark, tmp_path):
    made = lexical.build_text_index(spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert rows(lexical.grep_indexed(made, "anything")) == [] and rows(lexical.grep_like_indexed(made, "%")) == []
