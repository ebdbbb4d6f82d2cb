"""Views of the test tables as files, snapshots, chunks and vectors, whole tables each; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import content_hash
from quillspan.sources.files import local_path, write_files

#: What Spark's writers put into a path for a null.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_path(extension: str) -> Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(extension))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(file_path(".txt").alias("file_path"), F.col("text").alias("content"), content_hash(F.col("text")).alias("hash"), F.lit("text").alias("language"))


def old_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier snapshot: some files under another path, some with another content."""
    docs = table(spark, sf_dir, "documents")
    n = F.length("text")
    path = F.when(n % 5 == 0, F.concat(file_path(".txt"), F.lit(".bak"))).otherwise(file_path(".txt"))
    text = F.when(n % 3 == 0, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text"))
    return docs.select(path.alias("file_path"), text.alias("content"), content_hash(text).alias("hash"), F.lit("text").alias("language"))


def old_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lit("2020-01-01 00:00:00").cast("timestamp")
    return old_files(spark, sf_dir).select("file_path", "hash", t.alias("created_at"), t.alias("updated_at"))


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    t = F.lit("2020-01-01 00:00:00").cast("timestamp")
    start = (F.col("vec_id") * 7 % 200).cast("int")
    return v.select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("label/"), F.col("label").cast("string")).alias("file_path"), start.alias("start_line"), (start + (F.col("vec_id") % 9).cast("int")).alias("end_line"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("content"), t.alias("created_at"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lit("2020-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", t.alias("created_at"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vector of each label."""
    v = table(spark, sf_dir, "embeddings")
    return v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").cast("string").alias("query_id")).select("query_id", "embedding")


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("events/"), F.col("event_id").cast("string"), F.lit(".json")).alias("file_path"), F.col("props").alias("content"), F.lit("json").alias("language"))


def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as objects of three pairs, one of them nested, one an array."""
    e = table(spark, sf_dir, "events").where("props is not null")
    content = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"props":'), "props", F.lit(',"tags":["x",null]}'))
    return e.select(F.concat(F.lit("objects/"), F.col("event_id").cast("string"), F.lit(".json")).alias("file_path"), content.alias("content"), F.lit("json").alias("language"))


#: Documents as small programs, by language: the text around the two names, and the nodes as (id, parent, field, type, start, end, children);
#: places count from the start, with A and B for the lengths of the names.
PROGRAMS = {
    "en": ("typescript", ".ts", ("import a from 'b'; class ", " { ", "() { return 1 } }"), [
        (0, None, None, "program", "0", "45 + A + B", 2), (1, 0, None, "import_statement", "0", "18", 0), (2, 0, None, "class_declaration", "19", "45 + A + B", 4), (3, 2, "name", "type_identifier", "25", "25 + A", 0),
        (4, 2, None, "{", "26 + A", "27 + A", 0), (5, 2, None, "method_definition", "28 + A", "43 + A + B", 2), (6, 5, "name", "property_identifier", "28 + A", "28 + A + B", 0), (7, 5, "body", "statement_block", "31 + A + B", "43 + A + B", 0), (8, 2, None, "}", "44 + A + B", "45 + A + B", 0)]),
    "fr": ("tsx", ".tsx", ("const ", " = <", "/>"), [
        (0, None, None, "program", "0", "12 + A + B", 1), (1, 0, None, "lexical_declaration", "0", "12 + A + B", 1), (2, 1, None, "variable_declarator", "6", "12 + A + B", 2), (3, 2, "name", "identifier", "6", "6 + A", 0),
        (4, 2, "value", "jsx_self_closing_element", "9 + A", "12 + A + B", 1), (5, 4, "name", "identifier", "10 + A", "10 + A + B", 0)]),
    "de": ("javascript", ".js", ("function ", "() { return ", " }"), [
        (0, None, None, "program", "0", "23 + A + B", 1), (1, 0, None, "function_declaration", "0", "23 + A + B", 2), (2, 1, "name", "identifier", "9", "9 + A", 0), (3, 1, "body", "statement_block", "12 + A", "23 + A + B", 1), (4, 3, None, "identifier", "21 + A", "21 + A + B", 0)]),
}


def program_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as small programs: (file_path, content, language, a, b), a and b being the names in them."""
    d = table(spark, sf_dir, "documents").where(F.col("lang").isin(list(PROGRAMS)))
    d = d.select("lang", F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("a"), F.concat(F.lit("m"), F.length("text").cast("string")).alias("b"), "doc_id")

    def chosen(part) -> Column:
        out = F.lit(None)
        for lang, program in PROGRAMS.items():
            out = F.when(F.col("lang") == lang, part(program)).otherwise(out)
        return out

    path = F.concat(F.lit("code/"), F.col("doc_id").cast("string"), chosen(lambda p: F.lit(p[1])))
    content = chosen(lambda p: F.concat(F.lit(p[2][0]), "a", F.lit(p[2][1]), "b", F.lit(p[2][2])))
    return d.select(path.alias("file_path"), content.alias("content"), chosen(lambda p: F.lit(p[0])).alias("language"), "lang", "a", "b")


def program_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, language, node columns) of the programs."""
    kinds = "node_id int, parent_id int, field string, type string, start int, end int, start_row int, end_row int, child_count int"
    nodes = F.lit(None).cast(f"array<struct<{kinds.replace(' int', ':int').replace(' string', ':string')}>>")
    for lang, (_, _, _, rows) in PROGRAMS.items():
        at = lambda x: f"int({x.replace('A', 'length(a)').replace('B', 'length(b)')})"
        text = lambda x: "cast(null as string)" if x is None else f"'{x}'"
        parts = [f"named_struct('node_id', {k}, 'parent_id', cast({'null' if p is None else p} as int), 'field', {text(f)}, 'type', {text(t)}, 'start', {at(i)}, 'end', {at(j)}, 'start_row', 0, 'end_row', 0, 'child_count', {n})" for k, p, f, t, i, j, n in rows]
        nodes = F.when(F.col("lang") == lang, F.expr(f"array({', '.join(parts)})")).otherwise(nodes)
    return program_files(spark, sf_dir).select("file_path", "language", F.explode(nodes).alias("n")).select("file_path", "language", "n.*")


def class_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as TypeScript classes with a method for each line of their text: (file_path, content, language, name, lines)."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("name"), F.split("text", "\n").alias("lines"))
    body = F.array_join(F.transform("lines", lambda line, i: F.concat(F.lit("m"), i.cast("string"), F.lit("() { /* "), line, F.lit(" */ }\n"))), "")
    content = F.concat(F.lit("class "), "name", F.lit(" {\n"), body, F.lit("}"))
    return d.select(F.concat(F.lit("classes/"), "name", F.lit(".ts")).alias("file_path"), content.alias("content"), F.lit("typescript").alias("language"), "name", "lines")


def class_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, node columns) of the classes: program, class, its name and braces, and of each method the method, its name and its body."""
    f = class_files(spark, sf_dir)
    sizes = F.transform("lines", lambda line, i: F.length(line) + F.length(i.cast("string")) + 15)
    f = f.select("file_path", F.length("name").alias("n"), F.length("content").alias("size"), F.size("lines").alias("k"), sizes.alias("sizes"))
    f = f.withColumn("starts", F.transform("sizes", lambda x, i: F.expr("n + 9") + F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, y: a + y)))
    fixed = F.expr("""array(
      named_struct('node_id', 0, 'parent_id', cast(null as int), 'field', cast(null as string), 'type', 'program', 'start', 0, 'end', size, 'start_row', 0, 'end_row', k + 1, 'child_count', 1),
      named_struct('node_id', 1, 'parent_id', 0, 'field', cast(null as string), 'type', 'class_declaration', 'start', 0, 'end', size, 'start_row', 0, 'end_row', k + 1, 'child_count', k + 3),
      named_struct('node_id', 2, 'parent_id', 1, 'field', 'name', 'type', 'type_identifier', 'start', 6, 'end', 6 + n, 'start_row', 0, 'end_row', 0, 'child_count', 0),
      named_struct('node_id', 3, 'parent_id', 1, 'field', cast(null as string), 'type', '{', 'start', 7 + n, 'end', 8 + n, 'start_row', 0, 'end_row', 0, 'child_count', 0),
      named_struct('node_id', 4, 'parent_id', 1, 'field', cast(null as string), 'type', '}', 'start', size - 1, 'end', size, 'start_row', k + 1, 'end_row', k + 1, 'child_count', 0))""")
    each = F.expr("""flatten(transform(starts, (a, i) -> array(
      named_struct('node_id', 5 + 3 * i, 'parent_id', 1, 'field', cast(null as string), 'type', 'method_definition', 'start', a, 'end', a + sizes[i] - 1, 'start_row', i + 1, 'end_row', i + 1, 'child_count', 2),
      named_struct('node_id', 6 + 3 * i, 'parent_id', 5 + 3 * i, 'field', 'name', 'type', 'property_identifier', 'start', a, 'end', a + 1 + length(string(i)), 'start_row', i + 1, 'end_row', i + 1, 'child_count', 0),
      named_struct('node_id', 7 + 3 * i, 'parent_id', 5 + 3 * i, 'field', 'body', 'type', 'statement_block', 'start', a + 4 + length(string(i)), 'end', a + sizes[i] - 1, 'start_row', i + 1, 'end_row', i + 1, 'child_count', 0))))""")
    return f.select("file_path", F.explode(F.concat(fixed, each)).alias("x")).select("file_path", "x.*")


def written_files(spark: SparkSession, sf_dir: str, root: str) -> str:
    """Documents written out as a tree of text files, one each, in the shared folder.

    On a local file system Hadoop starts a process for the rights of each file and
    folder and puts a checksum beside each file, so tasks write there themselves,
    and documents whose ids begin alike share a folder; elsewhere Spark's writer
    makes a folder for each. Rows without an id have no path.
    """
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("source", "lang", "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    folder = local_path(spark, root)
    if folder is None:
        docs.write.option("maxRecordsPerFile", 1).partitionBy("source", "lang", "doc_id").text(root)
        return root

    def segment(name: str) -> Column:
        value = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
        return F.concat(F.lit(f"{name}="), F.coalesce(value, F.lit(NO_VALUE)), F.lit("/"))

    doc_id = F.col("doc_id").cast("string")
    name = F.concat(F.lit("doc_id="), F.substring(doc_id, 1, 1), F.lit("/doc_id="), doc_id, F.lit("."), F.monotonically_increasing_id().cast("string"), F.lit(".txt"))
    write_files(docs.select(F.concat(segment("source"), segment("lang"), name).alias("file_path"), F.concat("value", F.lit("\n")).alias("content")), folder)
    return root


def written_path(path: Column) -> Column:
    """source/lang=.../doc_id=... of a written file's path; null where the source is."""
    source, lang, doc_id = (F.regexp_extract(path, "^source=(.*)/lang=([^/]*)/(?:doc_id=[^/]*/)?(doc_id=-?[0-9]+)[./][^/]*$", k) for k in (1, 2, 3))
    value = F.url_decode(F.replace(source, F.lit("+"), F.lit("%2B")))
    return F.concat(F.nullif(value, F.lit(NO_VALUE)), F.lit("/lang="), lang, F.lit("/"), doc_id)


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their url's path and host as a file path."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("file_path"))


FILES = "files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS file_path, text AS content, sha256(text) AS hash FROM documents)"
OLD = """old_files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' || CASE WHEN length(text) % 5 = 0 THEN '.bak' ELSE '' END AS file_path,
  text || CASE WHEN length(text) % 3 = 0 THEN ' (old)' ELSE '' END AS content FROM documents), old AS (SELECT file_path, content, sha256(content) AS hash FROM old_files)"""
DIFF = f"""{FILES}, {OLD}, diff AS (SELECT coalesce(n.file_path, o.file_path) AS file_path,
  CASE WHEN o.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'deleted' WHEN n.hash = o.hash THEN 'unchanged' ELSE 'modified' END AS status,
  n.hash AS new_hash, o.hash AS old_hash FROM files n FULL JOIN old o ON n.file_path = o.file_path)"""
VECTOR_CHUNKS = "vchunks AS (SELECT vec_id::VARCHAR AS id, 'label/' || label AS file_path, (vec_id * 7 % 200)::INT AS start_line, (vec_id * 7 % 200 + vec_id % 9)::INT AS end_line, 'chunk ' || vec_id AS content, label, vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
PAGES = "paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS file_path FROM pages)"


def lines_sql(files_cte: str = "files", tokens: str = "ceil(length(line) / 4.0)::INT") -> str:
    """The line source's leaves."""
    return f"""lines AS (SELECT file_path, row, line, sum(length(line) + 1) OVER (PARTITION BY file_path ORDER BY row) - length(line) - 1 AS a, sum(length(line) + 1) OVER (PARTITION BY file_path ORDER BY row) - 1 AS b,
  {tokens} AS tokens, regexp_matches(line, '\\S') AS wanted
  FROM (SELECT file_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS row FROM {files_cte}))"""


def chunks_sql(files_cte: str = "files", target: int = 256, tokens: str = "ceil(length(line) / 4.0)::INT") -> str:
    """The line source's chunks, by the fold as a recursion over each file's lines with text."""
    return f"""{lines_sql(files_cte, tokens)},
numbered AS (SELECT *, sum(wanted::INT) OVER (PARTITION BY file_path ORDER BY row) + (NOT wanted)::INT AS k FROM lines),
pieces AS (SELECT file_path, k, min(a) AS a, max(b) AS b, min(row) AS r0, max(row) AS r1, sum(tokens)::INT AS tokens, bool_or(wanted) AS wanted FROM numbered GROUP BY file_path, k),
folded(file_path, k, a, b, r0, r1, tokens, part) AS (
  SELECT file_path, k, a, b, r0, r1, tokens, 0 FROM pieces WHERE k = 1 AND wanted
  UNION ALL
  SELECT p.file_path, p.k, CASE WHEN f.tokens + p.tokens <= {target} OR NOT p.wanted THEN f.a ELSE p.a END, p.b, CASE WHEN f.tokens + p.tokens <= {target} OR NOT p.wanted THEN f.r0 ELSE p.r0 END, p.r1,
    CASE WHEN f.tokens + p.tokens <= {target} OR NOT p.wanted THEN f.tokens + p.tokens ELSE p.tokens END, CASE WHEN f.tokens + p.tokens <= {target} OR NOT p.wanted THEN f.part ELSE f.part + 1 END
  FROM folded f JOIN pieces p ON p.file_path = f.file_path AND p.k = f.k + 1),
chunks AS (SELECT f.file_path || '__' || f.part AS id, f.file_path, f.r0::INT AS start_line, f.r1::INT AS end_line,
  '# filePath: ' || f.file_path || chr(10) || '---' || chr(10) || substr(s.content, (f.a + 1)::BIGINT, (f.b - f.a)::BIGINT) AS content
  FROM (SELECT file_path, part, min(a) AS a, max(b) AS b, min(r0) AS r0, max(r1) AS r1 FROM folded GROUP BY file_path, part) f JOIN {files_cte} s ON s.file_path = f.file_path)"""


_EXTENSIONS = " ".join(f"WHEN '{lang}' THEN '{p[1]}'" for lang, p in PROGRAMS.items())
_CONTENTS = " ".join("WHEN '{}' THEN '{}' || a || '{}' || b || '{}'".format(lang, *(x.replace("'", "''") for x in p[2])) for lang, p in PROGRAMS.items())
PROGRAM_FILES = f"""names AS (SELECT lang, doc_id, 'C' || doc_id AS a, 'm' || length(text) AS b FROM documents WHERE lang IN ({", ".join(f"'{x}'" for x in PROGRAMS)})),
programs AS (SELECT lang, a, b, 'code/' || doc_id || CASE lang {_EXTENSIONS} END AS file_path, CASE lang {_CONTENTS} END AS content FROM names)"""


def classes_sql(target: int, most: int) -> str:
    """The chunks of the classes: whole where a class is small; else its methods folded, name and brace before the first, the last brace after the last. Of methods that are too large, name and body go before the next that is not, or after the last."""
    return f"""classes AS (SELECT 'C' || doc_id AS name, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
methods AS (SELECT name, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM classes),
placed AS (SELECT name, i, 'm' || i || '() {{ /* ' || line || ' */ }}' AS method, length(name) + 9 + coalesce(sum(length(line) + length(i::VARCHAR) + 15) OVER (PARTITION BY name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM methods),
whole AS (SELECT name, 'class ' || name || ' {{' || chr(10) || string_agg(method || chr(10), '' ORDER BY i) || '}}' AS content, max(i) AS last FROM placed GROUP BY name),
sized AS (SELECT p.*, content, last, ceil(length(method) / 4.0)::INT AS own, ceil(length(content) / 4.0) <= {most} AS small, ceil(length(method) / 4.0) <= {most} AS wanted FROM placed p JOIN whole w ON w.name = p.name),
numbered AS (SELECT *, sum(wanted::INT) OVER (PARTITION BY name ORDER BY i) + (NOT wanted)::INT AS k FROM sized WHERE NOT small),
steps AS (SELECT name, k, CASE WHEN min(i) = 0 THEN 6 ELSE min(a) END AS a, CASE WHEN max(i) = any_value(last) THEN any_value(length(content)) ELSE max(a + length(method)) END AS b, min(i) AS i0, max(i) AS i1, max(i) FILTER (wanted) AS wi, bool_or(wanted) AS wanted,
  sum(CASE WHEN wanted THEN own ELSE ceil((length(i::VARCHAR) + 1) / 4.0)::INT + ceil((length(method) - length(i::VARCHAR) - 4) / 4.0)::INT END)::INT + CASE WHEN min(i) = 0 THEN ceil(length(name) / 4.0)::INT + 1 ELSE 0 END AS own FROM numbered GROUP BY name, k),
walked(name, k, a, b, i0, i1, wi, tokens, part) AS (SELECT name, k, a, b, i0, i1, wi, own, 0 FROM steps WHERE k = 1 AND wanted UNION ALL
  SELECT s.name, s.k, CASE WHEN w.tokens + s.own <= {target} OR NOT s.wanted THEN w.a ELSE s.a END, s.b, s.i0, s.i1, s.wi, CASE WHEN w.tokens + s.own <= {target} OR NOT s.wanted THEN w.tokens + s.own ELSE s.own END, CASE WHEN w.tokens + s.own <= {target} OR NOT s.wanted THEN w.part ELSE w.part + 1 END
  FROM walked w JOIN steps s ON s.name = w.name AND s.k = w.k + 1),
cut AS (SELECT name, part, min(a) AS a, max(b) AS b, min(i0) AS i0, max(i1) AS i1, string_agg('#   - ' || name || ' -> m' || wi || chr(10), '' ORDER BY k) AS scope FROM walked GROUP BY name, part
  UNION ALL SELECT DISTINCT name, 0, 0, length(content), -1, last + 1, '#   - ' || name || chr(10) FROM sized WHERE small)
SELECT 'classes/' || c.name || '.ts__' || part AS id, 'classes/' || c.name || '.ts' AS file_path, CASE WHEN i0 <= 0 THEN 0 ELSE i0 + 1 END::INT AS start_line, CASE WHEN b = length(content) THEN last + 2 ELSE i1 + 1 END::INT AS end_line,
  '# filePath: classes/' || c.name || '.ts' || chr(10) || '# scope:' || chr(10) || scope || '---' || chr(10) || substr(content, (a + 1)::BIGINT, (b - a)::BIGINT) AS content FROM cut c JOIN whole w ON w.name = c.name"""
