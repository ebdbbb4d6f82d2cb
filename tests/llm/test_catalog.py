import re

import __spark_entry__


def test_one_query_an_operator():
    names = list(__spark_entry__.queries())
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14)) and "pipeline" in names
    assert {"op7_jaccard_join", "op10_substring_dedup", "op11_rotated_centroids", "op13_hard_negatives"} <= set(__spark_entry__.oracle_sql())
