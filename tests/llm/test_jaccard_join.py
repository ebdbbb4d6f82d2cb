import random

from quillspan.llm import jaccard_join
from quillspan.llm.jaccard_join import near_copies


def brute(rows):
    def shingles(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def corpus():
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    passage = " ".join(r.choice(words) for _ in range(60))
    for g in range(12):
        base = [r.choice(words) for _ in range(r.choice([4, 9, 30, 120, 400]))]
        for _ in range(r.choice([1, 2, 9, 40])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(words)
            text = " ".join(copy)
            if g % 3 == 0:
                text += "\n" + passage
            rows.append((1000 - n, text if r.random() < 0.8 else text.upper()))
            n += 1
    rows += [(2001, None), (2002, ""), (2003, " \n"), (2004, "one two"), (2005, "One  two"), (2006, "one two three"), (2007, "ÉA b c d e f"), (2008, "éA b c d e f")]
    return rows


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as sid", "2 as root").repartition(5)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_copies(df).collect())


def test_matches_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_blocks_and_empty(spark, monkeypatch):
    assert got(spark, []) == []
    rows = [(i, "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 " + f"tail{i}") for i in range(40)]
    assert got(spark, rows) == brute(rows)


def test_very_long_texts(spark):
    """Whole texts decide: two long ones that differ at their ends only are near copies, one that differs in half is not."""
    from quillspan.llm.jaccard_join import near_copies

    words = [f"w{i}" for i in range(60_000)]
    rows = [(5, " ".join(words)), (3, " ".join(words + ["and", "some", "more", "at", "end"])), (4, " ".join(words[:30_000] + [f"v{i}" for i in range(30_000)])), (9, "short")]
    out = {r.doc_id: (r.component_id, r.n_shingles) for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sid", "2 as root")).collect()}
    assert out == {5: (3, 59_996), 3: (3, 60_001), 4: (4, 59_996), 9: (9, 1)}


def test_links_through_rows_without_an_id(spark):
    """Of three texts in a chain the middle one has no id: they are one class all the same."""
    words = [f"k{i}" for i in range(60)]
    chain = [" ".join(words[i : i + 40]) for i in (0, 3, 6)]
    rows = [(1, chain[0]), (None, chain[1]), (2, chain[2]), (None, "alone " * 9), (None, chain[1] + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.root) for r in near_copies(df).collect())
    assert [f[2] for f in found if f[0] in "12"] == [1, 1]
    assert len({f[3] for f in found if f[1] > 30}) == 1 and [f[2] for f in found if f[0] == "None"].count(1) == 2


def test_many_rows_of_one_id(spark):
    """Rows that share an id are as many texts: each is looked up by id and text, so none meets the others' sets."""
    r = random.Random(11)
    words = [f"m{i}" for i in range(4000)]
    bases = [[r.choice(words) for _ in range(40)] for _ in range(150)]
    rows = [(7, " ".join(b)) for b in bases] + [(7, " ".join([*b[:39], "end"])) for b in bases[:100]] + [(8 + i, " ".join([*b[:39], "other"])) for i, b in enumerate(bases[50:])]
    assert got(spark, rows) == brute(rows)


def test_cells_of_a_large_tile(spark, monkeypatch):
    """Cells hold each pair of a tile's sets once, none holds the tile, and tiles of one component are left out."""
    monkeypatch.setattr(jaccard_join, "SIDE", 8)
    rows = [(1, s, s % 5) for s in range(200)] + [(2, s, 7) for s in range(300, 350)] + [(3, 400, 1), (3, 401, 2)]
    cells = {}
    for r in jaccard_join._cells(spark.createDataFrame(rows, "tile long, sid long, root long").repartition(4)).collect():
        cells.setdefault(r.tile, []).append((r.sid, r.side))
    pairs = sorted((a, b) for c in cells.values() for a, x in c for b, y in c if a < b and (x != y or x < 0))
    assert pairs == [(a, b) for a in range(200) for b in range(a + 1, 200)] + [(400, 401)]
    assert max(map(len, cells.values())) <= 4 * 8


def test_matches_brute_force_in_cells(spark, monkeypatch):
    """Sets that share their rarest shingles without being near keep a tile open; compared in cells of a few sets, no link is lost."""
    monkeypatch.setattr(jaccard_join, "SIDE", 3)
    r = random.Random(3)
    shared = "one passage that very many of these texts begin with and that alone does not make them near"
    rows = []
    for g in range(40):
        base = [f"u{g}x{i}" for i in range(r.choice([12, 20, 40]))]
        for _ in range(3):
            copy = list(base)
            copy[r.randrange(len(copy))] = "other"
            rows.append((len(rows), shared + " " + " ".join(copy)))
    assert got(spark, rows) == brute(rows)
