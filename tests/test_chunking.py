import pytest

from quillspan.functions import trees
from quillspan.operators.chunk import chunk_files, classify_nodes, merge_spans, nodes_from_json, nodes_from_lines, rules, scope_paths, select_spans, with_tokens

SMALL, LARGE, TINY = (50, 100), (500, 1000), (15, 30)


def chunks(text, budget, language="json", nodes=None, path="a.json"):
    nodes = trees.json_nodes(text) if nodes is None else nodes
    return list(trees.chunks_of(path, text, language, nodes, *budget))


def bodies(found):
    return [c[4].split("---\n", 1)[1] for c in found]


def test_worked_json_example():
    text = '{"a":{"x":1,"y":2},"b":3}'
    found = trees.fold(trees.spans_of(trees.json_nodes(text), "json", text, 3), "json", text, 4)
    assert [(s[0], s[1], s[4], s[5]) for s in found] == [(0, 12, 9, [["a", "x"]]), (12, 19, 4, [["a", "y"]]), (19, 25, 3, [["b"]])]


def test_one_pair():
    assert chunks('{"k": 69}', SMALL, path="events/0.json") == [("events/0.json__0", "events/0.json", 0, 0, '# filePath: events/0.json\n# scope:\n#   - k\n---\n{"k": 69}')]


@pytest.mark.parametrize("text", ["{}", "[]", "", "42", '{"a":', "[1,]", "{'a': 1}", '{"a" 1}', "[1 2]", '{"a":1}}', "nul", '"\n"'])
def test_no_chunks(text):
    assert chunks(text, SMALL) == []


def test_json_properties():
    nested = '{"a": {"b": {"c": 1, "d": "' + "x" * 60 + '"}, "e": [1, 2, {"f": null}]}, "g": {}}'
    found = chunks(nested, TINY)
    assert all(x != y for c in found for line in c[4].split("\n") if line.startswith("#   - ") for x, y in zip(line[6:].split(" -> "), line[6:].split(" -> ")[1:], strict=False))
    assert "".join(bodies(found)).replace(" ", "") == nested.replace(" ", "")
    assert not any(b.lstrip().startswith(",") for b in bodies(found)[1:])
    four = '{\n"a": 1,\n"b": 2,\n"c": 3,\n"d": 4\n}'
    assert len(chunks(four, LARGE)) <= 2 and chunks(four, LARGE)[0][2:4] == (0, 5)
    assert len(chunks('{"a": "' + "x" * 280 + '", "b": "' + "y" * 280 + '"}', SMALL)) >= 2
    assert chunks('{"a-b": 1, "c d": 2, "\U0001f600": 3}', SMALL)
    assert "x" in chunks(r'{"k\"": "x\\"}', SMALL)[0][4]
    assert len(chunks("[" + ",".join('{"a": %d}' % i for i in range(20)) + "]", SMALL)) >= 1
    deep = "[" * 5000 + '{"a": 1}' + "]" * 5000
    assert len(chunks(deep, SMALL)) == 1


def test_lines():
    text = "aaaa\n\nbbbb\ncc"
    found = list(trees.chunks_of("f", text, "text", trees.line_nodes(text), 2, 9))
    assert [(c[2], c[3], c[4]) for c in found] == [(0, 2, "# filePath: f\n---\naaaa\n\nbbbb"), (3, 3, "# filePath: f\n---\ncc")]
    assert list(trees.chunks_of("f", " \n\n", "text", trees.line_nodes(" \n\n"), 2, 9)) == []


def node(k, parent, kind, text, part, field=None, leaf=True, begin=0):
    at = text.index(part, begin)
    rows = lambda i: text[:i].count("\n")
    return [k, parent, field, kind, at, at + len(part), rows(at), rows(at + len(part)), 0 if leaf else 1]


def test_typescript_tables():
    text = "import x from 'y'\nclass Foo {\n  bar() { return 1 }\n}"
    method, cls = "bar() { return 1 }", "class Foo {\n  bar() { return 1 }\n}"
    nodes = [
        node(0, None, "program", text, text, leaf=False), node(1, 0, "import_statement", text, "import x from 'y'"),
        node(2, 0, "class_declaration", text, cls, leaf=False), node(3, 2, "type_identifier", text, "Foo", "name"), node(4, 2, "{", text, "{"),
        node(5, 2, "method_definition", text, method, leaf=False), node(6, 5, "property_identifier", text, "bar", "name"), node(7, 2, "}", text, "}", begin=len(text) - 1),
    ]
    found = chunks(text, (50, 100), "typescript", nodes, "a.ts")
    assert found[0][0] == "a.ts__0" and "#   - Foo\n" in found[0][4] and bodies(found) == [text]
    small = chunks(text, (5, 6), "typescript", nodes, "a.ts")
    assert "#   - Foo -> bar\n" in small[-1][4] and small[-1][4].endswith("}\n}") and "# scope" not in small[0][4]
    assert bodies(small)[0].startswith("import") and all(a[2] <= b[2] for a, b in zip(small, small[1:], strict=False))
    assert not any(b.strip() in (")", "}", "]") for b in bodies(small))


def test_names():
    text = "const a = 1"
    nodes = [node(0, None, "lexical_declaration", text, text, leaf=False), node(1, 0, "variable_declarator", text, "a = 1", leaf=False), node(2, 1, "identifier", text, "a ", "name")]
    assert trees.scopes_of(nodes, "javascript", text)[0] == ["a "]
    jsx = "<Card><b/></Card>"
    nodes = [node(0, None, "jsx_element", jsx, jsx, leaf=False), node(1, 0, "jsx_opening_element", jsx, "<Card>", "open_tag", leaf=False), node(2, 1, "identifier", jsx, "Card", "name"), node(3, 0, "jsx_self_closing_element", jsx, "<b/>")]
    assert trees.scopes_of(nodes, "tsx", jsx)[3] == ["Card", "<jsx>"]
    assert trees.scopes_of([node(0, None, "class", "x", "x")], "typescript", "x")[0] == ["<anonymous>"]


def test_tables_equal_helper(spark):
    """The table forms (classify, select, merge, scopes) agree with the row-local chunker."""
    texts = {"a": "one two\n\nthree\n \nfour " * 9, "b": "x", "c": "", "d": "\n\n"}
    files = spark.createDataFrame([(p, t, "text") for p, t in texts.items()], "file_path string, content string, language string")
    nodes = classify_nodes(with_tokens(nodes_from_lines(files), files).selectExpr("*", "'text' as language"), rules(spark))
    spans = select_spans(nodes, 4).selectExpr("file_path", "start", "end", "start_row", "end_row", "tokens", "array(cast(array() as array<string>)) as scope", "kind")
    merged = {(r.file_path, r.part): (r.start, r.end, r.start_row, r.end_row) for r in merge_spans(spans, files, 6).collect()}
    want = {(p, k): s[:4] for p, t in texts.items() for k, s in enumerate(trees.fold(trees.spans_of(trees.line_nodes(t), "text", t, 4), "text", t, 6))}
    assert merged == want
    assert {(c.id, c.content) for c in chunk_files(files, 6, 4).collect()} == {(c[0], c[4]) for p, t in texts.items() for c in trees.chunks_of(p, t, "text", trees.line_nodes(t), 6, 4)}
    js = spark.createDataFrame([("j", '{"a": {"b": [1, 2]}, "c": 3}', "json"), ("k", "no", "json")], files.schema)
    table = nodes_from_json(js)
    scopes = {r.node_id: r.scope for r in scope_paths(table, js).collect()}
    assert scopes == trees.scopes_of(trees.json_nodes('{"a": {"b": [1, 2]}, "c": 3}'), "json", '{"a": {"b": [1, 2]}, "c": 3}')
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(chunk_files(js, 4, 3, "json")) == key(chunk_files(js, 4, 3, table)) != []
    nodes = classify_nodes(with_tokens(table, js).selectExpr("*", "'json' as language"), rules(spark))
    got = sorted((r.start, r.end, r.kind) for r in select_spans(nodes, 3).collect())
    assert got == sorted((s[0], s[1], s[6]) for s in trees.spans_of(trees.json_nodes('{"a": {"b": [1, 2]}, "c": 3}'), "json", '{"a": {"b": [1, 2]}, "c": 3}', 3))


def test_a_counter_of_the_callers(spark):
    """A counter that is not additive (distinct words), in batches: every distinct text goes to it once, and the chunks are those of a plain fold."""
    from quillspan.functions import trees
    from quillspan.operators.chunk import chunk_files

    r = __import__("random").Random(5)
    texts = {f"f{i}": "\n".join(" ".join(r.choice("abcdefg") for _ in range(r.choice([0, 3, 9]))) for _ in range(30)) for i in range(6)} | {"far": "𝔸𝔸 b\n\n𝔸 c d", "none": None}
    df = spark.createDataFrame([(p, t, "text") for p, t in texts.items()], "file_path string, content string, language string").coalesce(1)
    sent = spark.sparkContext.accumulator(0)

    def distinct_words(some):
        assert len(some) == len(set(some))
        sent.add(len(some))
        return [len(set(t.split())) for t in some]

    got = sorted(tuple(x) for x in chunk_files(df, 6, 50, counter=distinct_words).collect())
    want = []
    for p, t in texts.items():
        if t is not None:
            want += trees.chunks_of(p, t, "text", trees.line_nodes(t), 6, 50, lambda a, b, t=t: len(set(t[a:b].split())))
    assert got == sorted(want) and len(got) > 20
    assert sent.value == len({line for t in texts.values() if t is not None for line in t.split("\n")})
    with pytest.raises(Exception, match="the counter gave"):
        chunk_files(df, 6, 50, counter=lambda some: [1]).collect()


def test_counts_of_intervals(spark):
    """Counts in constant time equal those of the text cut out, beyond the basic plane too; and the node table's are the same."""
    from pyspark.sql import functions as F

    from quillspan.functions import trees
    from quillspan.operators import chunk

    for text in ("plain text", "𝔸b𝔹c字é", ""):
        count = trees.utf16_counter(text)
        assert all(count(a, b) == -(-len(text[a:b].encode("utf-16-le")) // 8) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
    files = spark.createDataFrame([("a", "one 𝔸𝔸𝔸\n\ntwo"), ("b", "x" * 9)], "file_path string, content string")
    nodes = chunk.with_tokens(chunk.nodes_from_lines(files), files)
    texts = {"a": "one 𝔸𝔸𝔸\n\ntwo", "b": "x" * 9}
    assert nodes.columns[-1] == "tokens" and all(n.tokens == -(-len(texts[n.file_path][n.start : n.end].encode("utf-16-le")) // 8) for n in nodes.collect())
    assert nodes.where(F.col("tokens").isNull()).count() == 0


def test_wide_scopes_equal_the_files(spark):
    """Names by joins and paths by doubling pointers are those of the per-file helper, over deep random trees of all scope kinds."""
    from quillspan.operators.chunk import scope_names, scope_paths_wide

    r = __import__("random").Random(12)
    kinds = ["pair", "jsx_element", "jsx_self_closing_element", "lexical_declaration", "class_declaration", "method_definition", "variable_declarator", "identifier", "property_identifier", "statement_block", "export_statement", "import_statement"]
    fields = [None, None, "key", "name", "open_tag", "body"]
    files, rows, want = [], [], {}
    for f in range(8):
        language = ["tsx", "json", "typescript", "javascript"][f % 4]
        content = "".join(r.choice('ab"c d') for _ in range(400))
        nodes = [[0, None, None, "program", 0, 400, 0, 0, 0]]
        for k in range(1, 60):
            parent = nodes[-1] if f < 4 and r.random() < 0.8 else r.choice(nodes)  # some trees are deep
            a, b = sorted((r.randint(parent[4], parent[5]), r.randint(parent[4], parent[5])))
            nodes.append([k, parent[0], r.choice(fields), r.choice(kinds), a, b, 0, 0, 0])
            parent[8] += 1
        files.append((f"f{f}", content, language))
        rows += [(f"f{f}", language, *n) for n in nodes]
        want |= {(f"f{f}", n): s for n, s in trees.scopes_of(nodes, language, content).items()}
    nodes = spark.createDataFrame(rows, "file_path string, language string, node_id int, parent_id int, field string, type string, start int, end int, start_row int, end_row int, child_count int")
    found = scope_paths_wide(nodes, scope_names(nodes, spark.createDataFrame(files, "file_path string, content string, language string")))
    got = {(x.file_path, x.node_id): x.scope for x in found.collect()}
    assert got == want and max(map(len, want.values())) > 5


def test_wide_fold_equals_the_files(spark):
    """Folds by running sums and doubling steps are those of the greedy fold, on random spans with gaps that close and gaps that do not."""
    from quillspan.operators.chunk import merge_spans_wide

    r = __import__("random").Random(17)
    rows, want = [], []
    for f in range(25):
        content, spans = "", []
        for k in range(r.choice([0, 1, 5, 60, 200])):
            kind = r.choice(["wanted", "wanted", "gap"]) if f % 5 else "gap" if k % 3 else "wanted"
            text = r.choice(["})", "}", "text", ","]) if kind == "gap" else "w" * r.randint(1, 9)
            spans.append((len(content), len(content) + len(text), k, k, r.choice([0, 1, 2, 5, 9, 30]), [["C", f"m{k % 4}"]] if kind == "wanted" else [], kind))
            content += text + " "
        if f == 24:
            spans = [s for s in spans if s[6] == "gap"]
        rows += [(f"f{f}", *s, s[6] == "gap" and content[s[0] : s[1]] in ("})", "}")) for s in spans]
        want += [(f"f{f}", k, *s) for k, s in enumerate(trees.fold(spans, "typescript", content, 12))]
    df = spark.createDataFrame(rows, "file_path string, start int, end int, start_row int, end_row int, tokens int, scope array<array<string>>, kind string, closing boolean")
    found = merge_spans_wide(df, 12)
    assert sorted(tuple(x[c] for c in ("file_path", "part", "start", "end", "start_row", "end_row", "tokens", "scope", "kind")) for x in found.collect()) == sorted(want) and len(want) > 100
    assert merge_spans_wide(df.limit(0), 12).collect() == []
