"""Registered queries of the index library and their SQL. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.globs import glob_filter
from quillspan.operators import chunk, diff, embed, index, lexical, maintain, ranges, search
from quillspan.plans import views as V
from quillspan.plans.views import table
from quillspan.sources.files import scan_files, wide_index
from quillspan.sources.store import VectorStore, empty_index, read_index, scratch_dir, write_index
from quillspan.streaming.index_stream import apply_batch, index_stream

_EXTENSION = "CASE lang WHEN 'en' THEN '.ts' WHEN 'fr' THEN '.mjs' WHEN 'de' THEN '.d.json' ELSE '.TS' END"


def _now() -> Column:
    return F.lit("2021-01-01 00:00:00").cast("timestamp")


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    return diff.diff_snapshot(V.files(spark, sf), V.old_documents(spark, sf))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.chunk_files(V.files(spark, sf))


def _old_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.chunk_files(V.old_files(spark, sf)).withColumn("created_at", _now())


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return diff.files_to_clean(_diff(spark, sf))


def scanned_files(spark, sf):
    """Documents written out as files and scanned again: some languages, without the ids that begin with 1."""
    found = scan_files(spark, V.written_files(spark, sf, scratch_dir(spark)), ["**/lang=en/**", "**/lang={fr,de}/**"], ["**/doc_id=1*/**"], {"txt": "text"})
    return found.select(V.written_path(F.col("file_path")).alias("file_path"), "content", "hash", "language")


def glob_pages(spark, sf):
    return glob_filter(V.page_paths(spark, sf), "file_path", ["**/{en,fr}/*", "blog.*/**"], ["*5", "m.*/de/**"])


def language_tags(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.expr(_EXTENSION)).alias("file_path"))
    return T.tag_language(d, "file_path").select("doc_id", "file_path", "language")


def wide(spark, sf):
    docs = V.vector_chunks(spark, sf).select("file_path").distinct().withColumn("hash", T.content_hash(F.col("file_path")))
    out = wide_index(docs, V.vector_chunks(spark, sf), V.vectors(spark, sf))
    return out.select("id", "file_path", "file_hash", "start_line", "end_line", "content", F.size("embedding").alias("width"))


def content_hashes(spark, sf):
    return V.files(spark, sf).select("file_path", "hash")


def snapshot_diff(spark, sf):
    return _diff(spark, sf)


def diff_counts(spark, sf):
    return diff.diff_summary(_diff(spark, sf))


def paths_to_clean(spark, sf):
    return _paths(spark, sf)


def paths_to_index(spark, sf):
    return diff.files_to_index(_diff(spark, sf))


def documents_removed(spark, sf):
    return maintain.remove_documents(V.old_documents(spark, sf), _paths(spark, sf)).select("file_path", "hash")


def chunks_removed(spark, sf):
    old = _old_chunks(spark, sf)
    kept, vectors = maintain.remove_chunks(old, old.select(F.col("id").alias("chunk_id")), _paths(spark, sf))
    return kept.select("id", "file_path", "start_line").join(vectors.select(F.col("chunk_id").alias("id")), "id")


def documents_inserted(spark, sf):
    out = maintain.insert_documents(V.old_documents(spark, sf), V.files(spark, sf), _now())
    return out.select("file_path", "hash", F.year("created_at").alias("created"))


def chunks_inserted(spark, sf):
    old = _old_chunks(spark, sf)
    paths = _paths(spark, sf)
    kept, _ = maintain.remove_chunks(old, old.select(F.col("id").alias("chunk_id")), paths)
    new = chunk.chunk_files(V.files(spark, sf).join(diff.files_to_index(_diff(spark, sf)), "file_path", "left_semi"))
    return maintain.insert_chunks(kept, new, _now()).select("id", "file_path", "start_line", "end_line")


def embeddings_inserted(spark, sf):
    v = V.vectors(spark, sf)
    again = v.select(F.concat(F.lit("copy/"), F.col("chunk_id")).alias("chunk_id"), "embedding")
    return maintain.insert_embeddings(v, again, _now(), 64).select("chunk_id", F.size("embedding").alias("width"))


def last_version(spark, sf):
    both = V.old_files(spark, sf).withColumn("turn", F.lit(1)).unionByName(V.files(spark, sf).withColumn("turn", F.lit(2)))
    return maintain.last_wins(both, "file_path", "turn").select("file_path", "hash", "turn")


def pending(spark, sf):
    c = V.vector_chunks(spark, sf)
    more = c.select(F.concat(F.lit("new/"), "id").alias("id"), "content")
    return maintain.pending_embeddings(c.select("id", "content").unionByName(more), V.vectors(spark, sf))


def documents_found(spark, sf):
    return maintain.get_documents(V.old_documents(spark, sf), V.old_files(spark, sf)).select("file_path", "hash")


def index_counts(spark, sf):
    """The whole incremental run from the old snapshot to the new one: what each file's index then holds."""
    root = scratch_dir(spark)
    for files in (V.old_files(spark, sf), V.files(spark, sf)):
        made = index.index_batch(files, read_index(spark, root, "p"), now=_now())
        write_index(made, root, "p")
        made.release()
    new = read_index(spark, root, "p")
    joined = new.documents.select("file_path", "hash").join(new.chunks.select("file_path", "id"), "file_path").join(new.embeddings.select(F.col("chunk_id").alias("id")), "id")
    return joined.groupBy("file_path", "hash").agg(F.count(F.lit(1)).alias("chunks"))


def index_written(spark, sf):
    """The first index of the old snapshot, written as a version and read again."""
    root = scratch_dir(spark)
    made = index.index_batch(V.old_files(spark, sf), empty_index(spark), now=_now())
    write_index(made, root, "p")
    made.release()
    back = read_index(spark, root, "p")
    return back.chunks.join(back.documents.select("file_path", "hash"), "file_path").groupBy("file_path", "hash").agg(F.count(F.lit(1)).alias("chunks"))


def index_streamed(spark, sf):
    """The documents, read as a stream of files and indexed by micro-batches."""
    root, docs = scratch_dir(spark), table(spark, sf, "documents")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf}/documents*.parquet")
    stream = stream.select(V.file_path(".txt").alias("file_path"), F.col("text").alias("content"), F.lit("text").alias("language"), F.lit(1).alias("arrived"))
    index_stream(stream, root, "p", f"{root}/progress").awaitTermination()
    back = read_index(spark, root, "p")
    return back.chunks.join(back.documents.select("file_path", "hash"), "file_path").groupBy("file_path", "hash").agg(F.count(F.lit(1)).alias("chunks"))


def index_late(spark, sf):
    """The documents, then an earlier snapshot of them that comes later: old versions do not replace new ones, other paths are added."""
    root = scratch_dir(spark)
    for files, at in ((V.files(spark, sf), 2), (V.old_files(spark, sf), 1)):
        made = apply_batch(files.withColumn("arrived", F.lit(at)), read_index(spark, root, "p"))
        write_index(made, root, "p")
        made.release()
    back = read_index(spark, root, "p")
    return back.chunks.join(back.documents.select("file_path", "hash"), "file_path").groupBy("file_path", "hash").agg(F.count(F.lit(1)).alias("chunks"))


def vectors_by_content(spark, sf):
    """The old and the new snapshot's chunks, embedded through one store: how many vectors it holds of each text, by its hash."""
    store = VectorStore(spark, scratch_dir(spark), "hashed_words")
    for files in (V.old_files(spark, sf), V.files(spark, sf)):
        embed.embed_chunks(chunk.chunk_files(files), store=store)
    return store.vectors().groupBy("h").agg(F.count(F.lit(1)).alias("vectors"))


def token_counts(spark, sf):
    return V.files(spark, sf).select("file_path", T.token_count(F.col("content")).alias("tokens"))


def json_nodes(spark, sf):
    return chunk.nodes_from_json(V.json_files(spark, sf)).select("file_path", "node_id", "parent_id", "type", "start", "end")


def line_nodes(spark, sf):
    return chunk.nodes_from_lines(V.files(spark, sf)).select("file_path", "node_id", "parent_id", "type", "start", "end", "start_row", "child_count")


def _tokens(spark, sf):
    files = V.files(spark, sf)
    nodes = chunk.with_tokens(chunk.nodes_from_lines(files), files).withColumn("language", F.lit("text"))
    return chunk.classify_nodes(nodes, chunk.rules(spark))


def classified_nodes(spark, sf):
    return _tokens(spark, sf).select("file_path", "node_id", "tokens", "wanted", "scope")


def json_pairs(spark, sf):
    """The pairs of objects with several."""
    nodes = chunk.nodes_from_json(V.json_objects(spark, sf)).where("type = 'pair'")
    return nodes.select("file_path", "start", "end", "child_count")


def json_node_counts(spark, sf):
    return chunk.nodes_from_json(V.json_objects(spark, sf)).groupBy("file_path", "type").agg(F.count(F.lit(1)).alias("n"))


def syntax_classified(spark, sf):
    """Roles and token counts of TypeScript, TSX and JavaScript nodes."""
    nodes = chunk.with_tokens(V.program_nodes(spark, sf), V.program_files(spark, sf))
    return chunk.classify_nodes(nodes, chunk.rules(spark)).select("file_path", "node_id", "tokens", "wanted", "scope", "import")


def syntax_scopes(spark, sf):
    files = V.program_files(spark, sf)
    return chunk.scope_paths(V.program_nodes(spark, sf), files).select("file_path", "node_id", F.array_join("scope", " -> ").alias("scope"))


def syntax_spans(spark, sf):
    """The nodes to emit where four tokens are the most."""
    nodes = chunk.with_tokens(V.program_nodes(spark, sf), V.program_files(spark, sf))
    return chunk.select_spans(chunk.classify_nodes(nodes, chunk.rules(spark)), 4).select("file_path", "node_id", "start", "end", "kind")


def syntax_chunks(spark, sf):
    return chunk.chunk_files(V.program_files(spark, sf), 50, 100, V.program_nodes(spark, sf))


def syntax_scopes_wide(spark, sf):
    """The same scopes by joins of nodes, without a file's nodes in one row."""
    nodes = V.program_nodes(spark, sf)
    return chunk.scope_paths_wide(nodes, chunk.scope_names(nodes, V.program_files(spark, sf))).select("file_path", "node_id", F.array_join("scope", " -> ").alias("scope"))


def class_chunks(spark, sf):
    """Classes with a method a line: small ones whole, others cut between methods, with the scopes of each chunk's methods."""
    return chunk.chunk_files(V.class_files(spark, sf), 60, 120, V.class_nodes(spark, sf))


def word_chunks(spark, sf):
    """Line chunks by a counter of the caller's, words."""
    return chunk.chunk_files(V.files(spark, sf), 64, 512, counter=lambda texts: [len(t.split()) for t in texts])


def grep_parts(spark, sf):
    """A rare pattern, looked up in a text index of small parts."""
    return lexical.grep_indexed(lexical.build_text_index(_chunks(spark, sf), part_bytes=1 << 18, bits=1 << 16), "token", 1000)


def grep_like_parts(spark, sf):
    index = lexical.build_text_index(_chunks(spark, sf), part_bytes=1 << 18, bits=1 << 16)
    return lexical.grep_like_indexed(index, "filePath: src_/en/%token", 1000)


def json_scopes(spark, sf):
    files = V.json_files(spark, sf)
    return chunk.scope_paths(chunk.nodes_from_json(files), files).select("file_path", "node_id", F.array_join("scope", " -> ").alias("scope"))


def selected_spans(spark, sf):
    return chunk.select_spans(_tokens(spark, sf), 1024).select("file_path", "start", "end", "tokens", "kind")


def merged_spans(spark, sf):
    spans = chunk.select_spans(_tokens(spark, sf), 1024)
    empty = F.array(F.array().cast("array<string>"))
    spans = spans.select("file_path", "start", "end", "start_row", "end_row", "tokens", empty.alias("scope"), "kind")
    return chunk.merge_spans(spans, V.files(spark, sf), 256).select("file_path", "part", "start", "end", "start_row", "end_row", "tokens")


def merged_spans_wide(spark, sf):
    """The same spans folded by running sums and doubling steps."""
    empty = F.array(F.array().cast("array<string>"))
    spans = chunk.select_spans(_tokens(spark, sf), 1024).withColumn("scope", empty).withColumn("closing", F.lit(False))
    return chunk.merge_spans_wide(spans, 256).select("file_path", "part", "start", "end", "start_row", "end_row", "tokens")


def closing_syntax(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.regexp_replace("props", "[^{}\\[\\],:]", "").alias("marks"), F.substring("props", -1, 1).alias("last"))
    return e.select("event_id", T.is_closing_syntax(F.col("marks"), F.lit("json")).alias("all_marks"), T.is_closing_syntax(F.col("last"), F.lit("typescript")).alias("last_mark"))


def headers(spark, sf):
    d = table(spark, sf, "documents")
    scope = F.array(F.array("source", "lang"), F.array().cast("array<string>"), F.array("lang"))
    return d.select("doc_id", T.render_header(F.col("doc_id").cast("string"), scope).alias("header"))


def line_chunks(spark, sf):
    return _chunks(spark, sf)


def json_chunks(spark, sf):
    return chunk.chunk_files(V.json_files(spark, sf), node_source="json")


def chunk_vectors(spark, sf):
    out = embed.embed_chunks(table(spark, sf, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("content")))
    return out.select("chunk_id", F.posexplode("embedding").alias("place", "value")).where("value > 0").select("chunk_id", "place", F.round(F.col("value").cast("double"), 5).alias("value"))


def unit_vectors(spark, sf):
    unit = table(spark, sf, "embeddings").select("vec_id", T.norm(F.col("embedding")).alias("n"), T.l2_normalize(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round("n", 6).alias("norm"), F.round(F.element_at("u", 1), 6).alias("head"), F.round(T.norm(F.col("u")), 6).alias("unit"))


def embedding_text(spark, sf):
    d = table(spark, sf, "embeddings").select("vec_id", T.format_embedding(F.transform("embedding", lambda x: F.round(x * 8).cast("int"))).alias("t"))
    bad = table(spark, sf, "documents").select((-F.col("doc_id") - 1).alias("vec_id"), F.col("text").alias("t"))
    return d.unionByName(bad).select("vec_id", F.size(T.parse_embedding(F.col("t"))).alias("n"))


def checked_widths(spark, sf):
    return T.check_dimensions(table(spark, sf, "embeddings"), 3072, 64).select("vec_id", F.size("embedding").alias("width"))


def _search(spark, sf):
    v = table(spark, sf, "embeddings")
    first = v.agg(F.min_by("embedding", "vec_id")).first()[0]
    return search.search(V.vector_chunks(spark, sf), V.vectors(spark, sf), first, 10)


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("distance", F.round("distance", 6))


def search_one(spark, sf):
    return _rounded(_search(spark, sf))


def search_many(spark, sf):
    return _rounded(search.search_batch(V.vector_chunks(spark, sf), V.vectors(spark, sf), V.vector_queries(spark, sf), 10))


def search_lists(spark, sf):
    lists = search.build_ann(V.vectors(spark, sf), 8)
    return _rounded(search.search_ann(lists, V.vector_chunks(spark, sf), V.vector_queries(spark, sf), 10, 8))


def search_probed(spark, sf):
    """The nearest in three of eight lists: approximate, so only each query's own vector, which lies in the first of them, is sure to come."""
    lists = search.build_ann(V.vectors(spark, sf), 8)
    return _rounded(search.search_ann(lists, V.vector_chunks(spark, sf), V.vector_queries(spark, sf), 10, 3)).where("rank = 1")


def search_ranges(spark, sf):
    found = search.search_batch(V.vector_chunks(spark, sf), V.vectors(spark, sf), V.vector_queries(spark, sf), 10)
    return ranges.compact_ranges(found)


def grep(spark, sf):
    return lexical.grep(_chunks(spark, sf), "tion", 100)


def grep_like(spark, sf):
    return lexical.grep_like(_chunks(spark, sf), "src_/en/%the%tion", 100)


def grep_ranges(spark, sf):
    return ranges.compact_ranges(lexical.grep(_chunks(spark, sf), "tion", 100))


def globbed(spark, sf):
    return lexical.glob(V.files(spark, sf), "src?/{en,fr}/*[13579].txt")


def lines_read(spark, sf):
    files = V.files(spark, sf)
    return T.read_lines(files, files.select("file_path", (F.length("content") % 7 - 1).alias("offset"), F.lit(4).alias("limit")))


def normalized_paths(spark, sf):
    p = V.page_paths(spark, sf)
    path = F.when(F.length("file_path") % 2 == 0, F.concat(F.lit("/"), "file_path")).otherwise(F.col("file_path"))
    return p.select("page_id", T.normalize_path(path).alias("file_path"))


def hit_ranges(spark, sf):
    return ranges.compact_ranges(V.vector_chunks(spark, sf))


_TOP = f"""WITH {V.VECTOR_CHUNKS}, q AS (SELECT min(vec_id)::VARCHAR AS query_id, arg_min(e, vec_id) AS v FROM vchunks GROUP BY label),
d AS (SELECT query_id, id AS chunk_id, file_path, start_line, end_line, list_cosine_distance(v, e) AS distance FROM q, vchunks),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id)::INT AS rank FROM d QUALIFY rank <= 10)"""
_MANY = _TOP + " SELECT query_id, rank, chunk_id, file_path, start_line, end_line, round(distance, 6) AS distance FROM top"
_CHUNKS = f"WITH RECURSIVE {V.FILES}, {V.chunks_sql()}"


def _ranges_sql(hits: str, rank: bool = False) -> str:
    r1, r2 = (", min(rank) AS rank", ", min(rank) AS first_rank") if rank else ("", "")
    return f"""marked AS (SELECT *, coalesce((start_line > max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS opens FROM {hits}),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM marked),
united AS (SELECT file_path, island, min(start_line) AS s, max(end_line) AS e{r1} FROM islands GROUP BY file_path, island)
SELECT file_path, string_agg(s || '-' || e, ', ' ORDER BY s, e) AS ranges{r2} FROM united GROUP BY file_path"""


_PROPS = """WITH p AS (SELECT 'events/' || event_id || '.json' AS file_path, regexp_extract(props, '"([^"]*)"', 1) AS key, length(regexp_extract(props, '"([^"]*)"', 1)) AS k, length(props) AS n FROM events WHERE props IS NOT NULL)"""
_WORDS = r"len(regexp_extract_all(line, '\S+'))::INT"
_CLEAN = "(SELECT file_path FROM diff WHERE status IN ('modified', 'deleted'))"
_SQL: dict[str, str] = {
    "glob_pages": f"WITH {V.PAGES} SELECT * FROM paths WHERE (regexp_matches(file_path, '^([^./][^/]*/)*(en|fr)/([^./][^/]*)?$') OR regexp_matches(file_path, '^blog\\.[^/]*/([^./][^/]*)?(/([^./][^/]*)?)*$')) AND NOT regexp_matches(file_path, '^(.*/)?[^/]*5$') AND NOT regexp_matches(file_path, '^m\\.[^/]*/de/.*$')",
    "language_tags": f"SELECT doc_id, doc_id || {_EXTENSION} AS file_path, CASE lang WHEN 'en' THEN 'typescript' WHEN 'fr' THEN 'javascript' ELSE 'json' END AS language FROM documents WHERE lang IN ('en', 'fr', 'de')",
    "wide": f"WITH {V.VECTOR_CHUNKS} SELECT id, file_path, sha256(file_path) AS file_hash, start_line, end_line, content, len(e)::INT AS width FROM vchunks",
    "content_hashes": f"WITH {V.FILES} SELECT file_path, hash FROM files",
    "snapshot_diff": f"WITH {V.DIFF} SELECT * FROM diff",
    "diff_counts": f"WITH {V.DIFF} SELECT count_if(status = 'new')::BIGINT AS new, count_if(status = 'modified')::BIGINT AS modified, count_if(status = 'unchanged')::BIGINT AS unchanged, count_if(status = 'deleted')::BIGINT AS deleted FROM diff",
    "paths_to_clean": f"WITH {V.DIFF} SELECT file_path FROM {_CLEAN}",
    "paths_to_index": f"WITH {V.DIFF} SELECT file_path FROM diff WHERE status IN ('new', 'modified')",
    "documents_removed": f"WITH {V.DIFF} SELECT file_path, hash FROM old WHERE file_path NOT IN {_CLEAN}",
    "chunks_removed": f"WITH RECURSIVE {V.DIFF}, {V.chunks_sql('old')} SELECT id, file_path, start_line FROM chunks WHERE file_path NOT IN {_CLEAN}",
    "documents_inserted": f"WITH {V.FILES}, {V.OLD} SELECT file_path, hash, 2020 AS created FROM old UNION ALL SELECT file_path, hash, 2021 FROM files WHERE file_path NOT IN (SELECT file_path FROM old)",
    "chunks_inserted": f"{_CHUNKS} SELECT id, file_path, start_line, end_line FROM chunks",
    "embeddings_inserted": "SELECT vec_id::VARCHAR AS chunk_id, len(embedding)::INT AS width FROM embeddings UNION ALL SELECT 'copy/' || vec_id, len(embedding)::INT FROM embeddings",
    "last_version": f"WITH {V.FILES}, {V.OLD} SELECT file_path, hash, 2 AS turn FROM files UNION ALL SELECT file_path, hash, 1 FROM old WHERE file_path NOT IN (SELECT file_path FROM files)",
    "pending": f"WITH {V.VECTOR_CHUNKS} SELECT 'new/' || id AS id, content FROM vchunks",
    "documents_found": f"WITH {V.OLD} SELECT file_path, hash FROM old",
    "index_counts": f"{_CHUNKS} SELECT c.file_path, f.hash, count(*) AS chunks FROM chunks c JOIN files f ON f.file_path = c.file_path GROUP BY ALL",
    "index_written": f"WITH RECURSIVE {V.OLD}, {V.chunks_sql('old')} SELECT c.file_path, f.hash, count(*) AS chunks FROM chunks c JOIN old f ON f.file_path = c.file_path GROUP BY ALL",
    "index_streamed": f"{_CHUNKS} SELECT c.file_path, f.hash, count(*) AS chunks FROM chunks c JOIN files f ON f.file_path = c.file_path GROUP BY ALL",
    "index_late": f"""WITH RECURSIVE {V.FILES}, {V.OLD}, newest AS (SELECT * FROM files UNION ALL SELECT * FROM old WHERE file_path NOT IN (SELECT file_path FROM files)), {V.chunks_sql('newest')}
      SELECT c.file_path, f.hash, count(*) AS chunks FROM chunks c JOIN newest f ON f.file_path = c.file_path GROUP BY ALL""",
    "vectors_by_content": f"""WITH RECURSIVE {V.FILES}, {V.OLD}, paths AS (SELECT 'new' || file_path AS file_path, content, file_path AS own FROM files UNION ALL SELECT 'old' || file_path, content, file_path FROM old), {V.chunks_sql('paths')}
      SELECT DISTINCT sha256('# filePath: ' || substr(content, 16)) AS h, 1::BIGINT AS vectors FROM chunks""",
    "token_counts": f"WITH {V.FILES} SELECT file_path, ceil(length(content) / 4.0)::INT AS tokens FROM files",
    "line_nodes": f"""WITH {V.FILES}, {V.lines_sql()} SELECT file_path, (row + 1)::INT AS node_id, 0 AS parent_id, CASE WHEN wanted THEN 'line' ELSE 'blank' END AS type, a::INT AS start, b::INT AS "end", row::INT AS start_row, 0 AS child_count FROM lines
      UNION ALL SELECT file_path, 0, NULL, 'document', 0, length(content)::INT, 0, len(string_split(content, chr(10)))::INT FROM files""",
    "classified_nodes": f"WITH {V.FILES}, {V.lines_sql()} SELECT file_path, (row + 1)::INT AS node_id, tokens, wanted, false AS scope FROM lines UNION ALL SELECT file_path, 0, ceil(length(content) / 4.0)::INT, false, false FROM files",
    "selected_spans": f"""WITH {V.FILES}, {V.lines_sql()} SELECT file_path, a::INT AS start, b::INT AS "end", tokens, CASE WHEN wanted THEN 'wanted' ELSE 'gap' END AS kind FROM lines""",
    "merged_spans": f"""{_CHUNKS} SELECT file_path, part::INT AS part, min(a)::INT AS start, max(b)::INT AS "end", min(r0)::INT AS start_row, max(r1)::INT AS end_row, max(tokens)::INT AS tokens FROM folded GROUP BY file_path, part""",
    "closing_syntax": r"SELECT event_id, coalesce(regexp_full_match(regexp_replace(props, '[^{}\[\],:]', '', 'g'), '[\s\]},]+'), false) AS all_marks, coalesce(regexp_full_match(right(props, 1), '[\s)\]}>]+'), false) AS last_mark FROM events",
    "headers": "SELECT doc_id, '# filePath: ' || doc_id || chr(10) || '# scope:' || chr(10) || '#   - ' || source || ' -> ' || lang || chr(10) || '#   - ' || lang || chr(10) || '---' || chr(10) AS header FROM documents",
    "line_chunks": f"{_CHUNKS} SELECT id, file_path, start_line, end_line, content FROM chunks",
    "chunk_vectors": """WITH w AS (SELECT conv_id || '/' || turn AS chunk_id, unnest(regexp_extract_all(text, '\\S+')) AS word FROM conversations),
      c AS (SELECT chunk_id, (('0x' || substr(md5(word), 1, 8))::UBIGINT % 64)::INT AS place, count(*) AS n FROM w GROUP BY ALL)
      SELECT chunk_id, place, round((n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)))::FLOAT::DOUBLE, 5) AS value FROM c""",
    "unit_vectors": "SELECT vec_id, round(n, 6) AS norm, round(e[1] / n, 6) AS head, 1.0::DOUBLE AS unit FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)",
    "embedding_text": "SELECT vec_id, 64 AS n FROM embeddings UNION ALL SELECT -doc_id - 1, NULL FROM documents",
    "checked_widths": "SELECT vec_id, len(embedding)::INT AS width FROM embeddings",
    "search_one": f"WITH {V.VECTOR_CHUNKS}, q AS (SELECT arg_min(e, vec_id) AS v FROM vchunks) SELECT id AS chunk_id, file_path, start_line, end_line, round(list_cosine_distance(v, e), 6) AS distance FROM q, vchunks ORDER BY round(list_cosine_distance(v, e), 9), id LIMIT 10",
    "search_many": _MANY,
    "search_lists": _MANY,
    "search_probed": _TOP + " SELECT query_id, rank, chunk_id, file_path, start_line, end_line, round(distance, 6) AS distance FROM top WHERE rank = 1",
    "search_ranges": f"{_TOP}, {_ranges_sql('top', True)}",
    "grep": f"{_CHUNKS} SELECT file_path, start_line, end_line, content FROM chunks WHERE contains(content, 'tion') ORDER BY file_path, start_line, id LIMIT 100",
    "grep_like": f"{_CHUNKS} SELECT file_path, start_line, end_line, content FROM chunks WHERE content LIKE '%src_/en/%the%tion%' ORDER BY file_path, start_line, id LIMIT 100",
    "grep_parts": f"{_CHUNKS} SELECT file_path, start_line, end_line, content FROM chunks WHERE contains(content, 'token') ORDER BY file_path, start_line, id LIMIT 1000",
    "grep_like_parts": f"{_CHUNKS} SELECT file_path, start_line, end_line, content FROM chunks WHERE content LIKE '%filePath: src_/en/%token%' ORDER BY file_path, start_line, id LIMIT 1000",
    "word_chunks": f"WITH RECURSIVE {V.FILES}, {V.chunks_sql(target=64, tokens=_WORDS)} SELECT id, file_path, start_line, end_line, content FROM chunks",
    "class_chunks": f"WITH RECURSIVE {V.classes_sql(60, 120)}",
    "grep_ranges": f"{_CHUNKS}, hits AS (SELECT * FROM chunks WHERE contains(content, 'tion') ORDER BY file_path, start_line, id LIMIT 100), {_ranges_sql('hits')}",
    "globbed": f"WITH {V.FILES} SELECT DISTINCT file_path FROM files WHERE regexp_matches(file_path, '^src[^/]/(en|fr)/[^/]*[13579]\\.txt$')",
    "lines_read": f"""WITH {V.FILES}, r AS (SELECT file_path, greatest(length(content) % 7 - 1, 1) AS o, string_split(content, chr(10)) AS l FROM files WHERE content <> '')
      SELECT file_path, coalesce((SELECT string_agg(n || ': ' || l[n], chr(10) ORDER BY n) FROM generate_series(o, least(o + 3, len(l))) g(n)), '') AS text FROM r UNION ALL SELECT file_path, '' FROM files WHERE content = ''""",
    "normalized_paths": f"WITH {V.PAGES} SELECT page_id, '/' || file_path AS file_path FROM paths",
    "hit_ranges": f"WITH {V.VECTOR_CHUNKS}, {_ranges_sql('vchunks')}",
    # props has one pair, so its nodes are eleven with places that follow from the lengths of key (k) and value (v).
    "json_nodes": f"""{_PROPS} SELECT file_path, unnest(range(11))::INT AS node_id, unnest([NULL, 0, 1, 1, 3, 4, 4, 4, 3, 3, 1])::INT AS parent_id,
      unnest(['document', 'object', '{{', 'pair', 'string', '"', 'string_content', '"', ':', 'number', '}}']) AS type,
      unnest([0, 0, 0, 1, 1, 1, 2, k + 2, k + 3, k + 5, n - 1])::INT AS start, unnest([n, n, 1, n - 1, k + 3, 2, k + 2, k + 3, k + 4, n - 1, n])::INT AS "end" FROM p""",
    "json_scopes": f"""{_PROPS} SELECT file_path, unnest(range(11))::INT AS node_id, unnest(['', '', '', key, key, key, key, key, key, key, '']) AS scope FROM p""",
    "json_chunks": """WITH e AS (SELECT 'events/' || event_id || '.json' AS file_path, props FROM events WHERE props IS NOT NULL)
      SELECT file_path || '__0' AS id, file_path, 0 AS start_line, 0 AS end_line, '# filePath: ' || file_path || chr(10) || '# scope:' || chr(10) || '#   - ' || regexp_extract(props, '"([^"]*)"', 1) || chr(10) || '---' || chr(10) || props AS content FROM e""",
}


def _programs(values: dict[str, list], kind: str) -> str:
    """A list by language, one entry a node."""
    return "CASE lang " + " ".join(f"WHEN '{lang}' THEN [{', '.join(map(str, v))}]" for lang, v in values.items()) + f" END::{kind}[]"


def _by_node(pick: Callable) -> dict[str, list]:
    return {lang: [pick(n) for n in p[3]] for lang, p in V.PROGRAMS.items()}


def _place(x: str) -> str:
    return x.replace("A", "length(a)").replace("B", "length(b)")


_WANTED, _SCOPED = ("import_statement", "class_declaration", "method_definition", "lexical_declaration", "function_declaration"), ("class_declaration", "method_definition", "lexical_declaration", "jsx_self_closing_element", "function_declaration")
_IDS = "unnest(" + _programs(_by_node(lambda n: n[0]), "INT") + ") AS node_id"
_SQL |= {
    "scanned_files": "SELECT source || '/lang=' || lang || '/doc_id=' || doc_id AS file_path, text || chr(10) AS content, sha256(text || chr(10)) AS hash, 'text' AS language FROM documents WHERE lang IN ('en', 'fr', 'de') AND doc_id::VARCHAR NOT LIKE '1%'",
    "json_pairs": """WITH o AS (SELECT 'objects/' || event_id || '.json' AS file_path, length(event_id::VARCHAR) AS i, length(props) AS p FROM events WHERE props IS NOT NULL)
      SELECT file_path, unnest([1, 7 + i, 16 + i, 16 + i + p])::INT AS start, unnest([6 + i, 15 + i + p, 14 + i + p, 33 + i + p])::INT AS "end", 3 AS child_count FROM o""",
    "json_node_counts": """WITH o AS (SELECT 'objects/' || event_id || '.json' AS file_path FROM events WHERE props IS NOT NULL)
      SELECT file_path, unnest(['document', 'object', 'pair', 'array', 'string', '"', 'string_content', ':', ',', '{', '}', '[', ']', 'number', 'null']) AS type, unnest([1, 2, 4, 1, 5, 10, 5, 4, 3, 2, 2, 1, 1, 2, 1])::BIGINT AS n FROM o""",
    "syntax_classified": f"""WITH {V.PROGRAM_FILES} SELECT file_path, {_IDS}, unnest({_programs(_by_node(lambda n: f"ceil((({_place(n[5])}) - ({_place(n[4])})) / 4.0)"), "INT")}) AS tokens,
      unnest({_programs(_by_node(lambda n: n[3] in _WANTED), "BOOLEAN")}) AS wanted, unnest({_programs(_by_node(lambda n: n[3] in _SCOPED), "BOOLEAN")}) AS scope, unnest({_programs(_by_node(lambda n: n[3] == "import_statement"), "BOOLEAN")}) AS "import" FROM programs""",
    "syntax_scopes": f"""WITH {V.PROGRAM_FILES} SELECT file_path, {_IDS}, unnest({_programs({"en": ["''", "''", "a", "a", "a", "a || ' -> ' || b", "a || ' -> ' || b", "a || ' -> ' || b", "a"], "fr": ["''", "a", "a", "a", "a || ' -> ' || b", "a || ' -> ' || b"], "de": ["''", "a", "a", "a", "a"]}, "VARCHAR")}) AS scope FROM programs""",
    # Above four tokens everything is descended into; leaves and wanted leaves are left.
    "syntax_spans": f"""WITH {V.PROGRAM_FILES}, n AS (SELECT file_path, {_IDS}, unnest({_programs(_by_node(lambda n: _place(n[4])), "INT")}) AS start, unnest({_programs(_by_node(lambda n: _place(n[5])), "INT")}) AS "end",
      unnest({_programs(_by_node(lambda n: n[6] == 0), "BOOLEAN")}) AS leaf, unnest({_programs(_by_node(lambda n: n[3] == "import_statement"), "BOOLEAN")}) AS wanted, unnest({_programs(_by_node(lambda n: n[3] in _WANTED), "BOOLEAN")}) AS role FROM programs)
      SELECT file_path, node_id, start, "end", CASE WHEN role THEN 'wanted' ELSE 'gap' END AS kind FROM n m WHERE (leaf OR role AND ceil(("end" - start) / 4.0) <= 4)
        AND NOT EXISTS (SELECT 1 FROM n o WHERE o.file_path = m.file_path AND o.node_id < m.node_id AND o.role AND ceil((o."end" - o.start) / 4.0) <= 4 AND o.start <= m.start AND m."end" <= o."end")""",
    "syntax_chunks": f"""WITH {V.PROGRAM_FILES} SELECT file_path || '__0' AS id, file_path, 0 AS start_line, 0 AS end_line, '# filePath: ' || file_path || chr(10) || '# scope:' || chr(10) || '#   - ' || a || chr(10) || '---' || chr(10) || content AS content FROM programs""",
}


_SQL["merged_spans_wide"] = _SQL["merged_spans"]
_SQL["syntax_scopes_wide"] = _SQL["syntax_scopes"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        scanned_files, json_pairs, json_node_counts, syntax_classified, syntax_scopes, syntax_spans, syntax_chunks, search_probed, glob_pages, language_tags, wide, content_hashes, snapshot_diff, diff_counts, paths_to_clean, paths_to_index, documents_removed, chunks_removed,
        documents_inserted, chunks_inserted, embeddings_inserted, last_version, pending, documents_found, index_counts, index_written, index_streamed, index_late, vectors_by_content, token_counts, json_nodes, line_nodes,
        classified_nodes, class_chunks, syntax_scopes_wide, merged_spans_wide, word_chunks, grep_parts, grep_like_parts, json_scopes, selected_spans, merged_spans, closing_syntax, headers, line_chunks, json_chunks, chunk_vectors, unit_vectors, embedding_text,
        checked_widths, search_one, search_many, search_lists, search_ranges, grep, grep_like, grep_ranges, globbed, lines_read, normalized_paths, hit_ranges,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
