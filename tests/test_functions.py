import re

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.globs import glob_filter, glob_regex


@pytest.mark.parametrize("pattern,yes,no", [
    ("*.ts", ["a.ts"], ["a/b.ts", "a.tsx"]), ("**/*.ts", ["a.ts", "a/b/c.ts"], ["a.js"]), ("**/x", ["x", "a/x"], ["xx", "a/xx"]),
    ("a/**", ["a/b", "a/b/c"], ["b/a"]), ("{a,b}.js", ["a.js", "b.js"], ["c.js"]), ("[!ab].js", ["c.js"], ["a.js", "/.js"]), ("[ab]?", ["a1"], ["c1", "a/"]),
    (r"\*.js", ["*.js"], ["a.js"]), ("a+b(c).js", ["a+b(c).js"], ["aab(c).js"]), ("a,b", ["a,b"], ["a"]), ("a/**/b", ["a/b", "a/x/y/b"], ["a/xb"]),
])
def test_globs(pattern, yes, no):
    r = re.compile(glob_regex(pattern))
    assert all(r.search(p) for p in yes) and not any(r.search(p) for p in no)


def test_glob_filter_and_dotfiles(spark):
    df = spark.createDataFrame([(p,) for p in ["src/a.ts", "src/node_modules/b.ts", ".git/c.ts", "src/.d.ts", "x.min.ts", "lib/e.ts"]], "p string")
    got = lambda i, e: sorted(r.p for r in glob_filter(df, "p", i, e).collect())
    assert got(["**/*.ts"], ["node_modules", "*.min.ts"]) == ["lib/e.ts", "src/a.ts", "src/node_modules/b.ts"]
    assert got(["**/*.ts"], ["**/node_modules/**", "lib/*"]) == ["src/a.ts", "x.min.ts"]
    assert got([], []) == []


def test_languages(spark):
    df = spark.createDataFrame([(p,) for p in ["a.ts", "b.tsx", "c.json", "d.js", "e.mjs", "f.cjs", "g.TS", "noext", "h.md", "i.d.ts"]], "p string")
    assert {r.p: r.language for r in T.tag_language(df, "p", {"md": "text"}).collect()} == {"a.ts": "typescript", "b.tsx": "tsx", "c.json": "json", "d.js": "javascript", "e.mjs": "javascript", "f.cjs": "javascript", "h.md": "text", "i.d.ts": "typescript"}


def test_tokens_headers_paths(spark):
    df = spark.createDataFrame([("", 0), ("a", 1), ("abcd", 1), ("abcde", 2), ("a😀b", 1), ("😀😀b", 2)], "t string, n int")
    assert all(r.got == r.n for r in df.withColumn("got", T.token_count(F.col("t"))).collect())
    assert df.select(T.token_count(F.col("t"), F.length)).first()[0] == 0
    head = spark.sql("select 'p' as p, array(array('A','b'), cast(array() as array<string>)) as s, cast(array() as array<array<string>>) as e, 'x' as r, '/y' as a")
    row = head.select(T.render_header(F.col("p"), F.col("s")), T.render_header(F.col("p"), F.col("e")), T.normalize_path(F.col("r")), T.normalize_path(F.col("a"))).first()
    assert list(row) == ["# filePath: p\n# scope:\n#   - A -> b\n---\n", "# filePath: p\n---\n", "/x", "/y"]


@pytest.mark.parametrize("language,yes,no", [("typescript", ["} )", ">"], ["", "a}", ","]), ("json", ["},", " ]"], [")", ""]), ("tsx", ["/> x", "</Foo.Bar>", ")"], ["<Foo>"]), ("text", [], ["}"])])
def test_closing(spark, language, yes, no):
    df = spark.createDataFrame([(t, t in yes) for t in yes + no], "t string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", T.is_closing_syntax(F.col("t"), F.lit(language))).collect())


def test_embeddings_as_text(spark):
    df = spark.createDataFrame([("[1, 2.5]", 2), ("[]", None), ('[1,"x"]', None), ("{", None), (None, None), ("[1,null]", None), ('"a"', None)], "t string, n int")
    got = df.select("n", T.parse_embedding(F.col("t")).alias("e")).collect()
    assert all((len(r.e) if r.e else None) == r.n for r in got)
    assert T.rejected_embeddings(df, "t").count() == 6
    with pytest.raises(Exception, match="not an embedding"):
        T.parsed_or_raise(df, "t", "e").collect()
    assert df.limit(1).select(T.format_embedding(T.parse_embedding(F.col("t")))).first()[0] == "[1.0,2.5]"
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "embedding array<float>")
    assert [r[0] for r in v.select(T.l2_normalize(F.col("embedding"))).collect()] == [[0.6, 0.8], None]
    assert T.check_dimensions(v, 3072, 2).count() == 2
    with pytest.raises(Exception, match="not of width 3"):
        T.check_dimensions(v, 3).collect()


def test_read_lines(spark):
    files = spark.createDataFrame([("a", "x\r\ny\nz\n"), ("e", ""), ("b", "only")], "file_path string, content string")
    ask = spark.createDataFrame([("a", 1, 2000), ("a", 0, 2), ("a", 3, 9), ("a", 9, 2), ("e", 1, 5), ("b", -4, 1), ("b", 1, 0), ("none", 1, 1)], "file_path string, offset int, limit int")
    got = sorted((r.file_path, r.text) for r in T.read_lines(files, ask).collect())
    assert got == sorted([("a", "1: x\n2: y\n3: z\n4: "), ("a", "1: x\n2: y"), ("a", "3: z\n4: "), ("a", ""), ("e", ""), ("b", "1: only"), ("b", "")])
