"""Chunking: node tables, classification, span selection, the fold, and the whole chunker.

The chunker is row-local: a file's nodes stay beside its content, so nothing is
shuffled. The table forms of its steps (one row per node or span) serve callers
that bring syntax nodes of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quillspan.functions import trees
from quillspan.schemas import NODE, SPAN
from quillspan.sources.store import kept, scratch_dir

#: Characters of files whose nodes are held at once.
FILE_CHARS = 1 << 20
_NODE = [x.split()[0] for x in NODE.split(", ")]
_SPAN_NAMES = ["start", "end", "start_row", "end_row", "tokens", "scope", "kind"]
_NODE_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 5]
_CHUNK_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]


def _table(rows: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def nodes_from_json(files: DataFrame) -> DataFrame:
    """(file_path, node columns) of the JSON texts in files(file_path, content); other texts have no nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[p, *n] for p, c in zip(b.column("file_path").to_pylist(), b.column("content").to_pylist(), strict=True) for n in trees.json_nodes(c or "")]
            yield _table(rows, [pa.string(), *_NODE_TYPES], ["file_path", *_NODE])

    return files.select("file_path", "content").mapInArrow(run, f"file_path string, {NODE}")


def nodes_from_lines(files: DataFrame) -> DataFrame:
    """(file_path, node columns): under a root, a `line` leaf per line with text and a `blank` leaf per other line. Built-in functions only."""
    lines = files.select("file_path", "content", F.posexplode(F.split("content", "\n")).alias("row", "line"))
    before = Window.partitionBy("file_path").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("line")
    at = lines.select("file_path", "row", size.alias("size"), F.when(F.col("line").rlike(r"\S"), "line").otherwise("blank").alias("type"))
    at = at.withColumn("start", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)).cast("int"))
    none = F.lit(None).cast("string")
    leaves = at.select("file_path", (F.col("row") + 1).alias("node_id"), F.lit(0).alias("parent_id"), none.alias("field"), "type", "start", (F.col("start") + F.col("size")).alias("end"), F.col("row").alias("start_row"), F.col("row").alias("end_row"), F.lit(0).alias("child_count"))
    count = F.size(F.split("content", "\n"))
    roots = files.select("file_path", F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), none.alias("field"), F.lit("document").alias("type"), F.lit(0).alias("start"), F.length("content").alias("end"), F.lit(0).alias("start_row"), (count - 1).alias("end_row"), count.alias("child_count"))
    return leaves.unionByName(roots)


def rules(spark) -> DataFrame:
    return spark.createDataFrame(trees.rules(), "language string, type string, wanted boolean, scope boolean, import boolean")


def classify_nodes(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """nodes(language, type, ...) with wanted, scope and import; the rules are a small table, which Spark sends to the executors by its own estimate."""
    joined = nodes.join(table, ["language", "type"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("wanted", "scope", "import")})


def _with_nodes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """files(file_path, content, language) with their nodes as an array; a file's nodes are bounded by the file."""
    packed = nodes.groupBy("file_path").agg(F.collect_list(F.struct(*_NODE)).alias("nodes"))
    return files.select("file_path", "content", "language").join(packed, "file_path")


def scope_paths(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, node_id, scope): names of the enclosing scopes from the outermost in, a scope's own included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, k, s) for p, c, lang, ns in zip(*(b.column(x).to_pylist() for x in ("file_path", "content", "language", "nodes")), strict=True) for k, s in sorted(trees.scopes_of([[n[x] for x in _NODE] for n in ns], lang, c).items())]
            yield _table(rows, [pa.string(), pa.int32(), pa.list_(pa.string())], ["file_path", "node_id", "scope"])

    return _with_nodes(files, nodes).mapInArrow(run, "file_path string, node_id int, scope array<string>")


def _first(hit: Column, name: str) -> Column:
    """The first child, by place, that fits."""
    return F.min(F.when(hit, F.struct("start", "end", "node_id"))).alias(name)


def scope_names(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, node_id, name) of the scope nodes of nodes(file_path, language, node columns), by joins of nodes with their children."""
    known = classify_nodes(nodes.select("file_path", "language", *_NODE), rules(nodes.sparkSession))
    scopes = known.where(F.col("scope") & ~F.col("import")).select("file_path", "node_id", "type")
    kids = nodes.where("parent_id is not null").groupBy("file_path", F.col("parent_id").alias("node_id")).agg(
        _first(F.col("field") == "key", "key"), _first(F.col("field") == "name", "name"), _first(F.col("field") == "open_tag", "tag"),
        _first(F.col("type") == "variable_declarator", "declarator"), _first(F.col("type").isin(*trees.IDENTIFIERS), "identifier"),
    )
    found = scopes.join(kids, ["file_path", "node_id"], "left")
    below = kids.select("file_path", F.col("node_id").alias("below"), F.col("name").alias("below_name"))
    inner = F.when(F.col("type") == "jsx_element", F.col("tag.node_id")).when(F.col("type").isin("lexical_declaration", "variable_declaration"), F.col("declarator.node_id"))
    found = found.withColumn("below", inner).join(below, ["file_path", "below"], "left")
    place = (
        F.when(F.col("type") == "pair", F.col("key")).when(F.col("type") == "jsx_element", F.col("below_name"))
        .when(F.col("type") == "jsx_self_closing_element", F.col("name")).otherwise(F.coalesce("name", "below_name", "identifier"))
    )
    unnamed = F.when(F.col("type") == "pair", "<pair>").when(F.col("type").startswith("jsx_"), "<jsx>").otherwise("<anonymous>")
    found = found.select("file_path", "node_id", (F.col("type") == "pair").alias("quoted"), place.alias("place"), unnamed.alias("unnamed"))
    # Only the names' places meet the contents, as one row a file.
    named = found.where("place is not null").groupBy("file_path").agg(F.collect_list(F.struct("node_id", "quoted", "place.start", "place.end")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, c, at in zip(*(b.column(x).to_pylist() for x in ("file_path", "content", "at")), strict=True):
                for n in at:
                    text = c[n["start"] : n["end"]]
                    rows.append((p, n["node_id"], trees.unquoted(text) if n["quoted"] else text))
            yield _table(rows, [pa.string(), pa.int32(), pa.string()], ["file_path", "node_id", "name"])

    texts = files.select("file_path", "content").join(named, "file_path").mapInArrow(run, "file_path string, node_id int, name string")
    return texts.union(found.where("place is null").select("file_path", "node_id", "unnamed"))


def scope_paths_wide(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """As scope_paths, of nodes(file_path, node_id, parent_id) and names(file_path, node_id, name), for trees of any size.

    Pointers double: a node holds the names up to some ancestor, and takes over
    what that ancestor holds up to its own, so trees of depth d take log2(d) joins,
    and no file is gathered.
    """
    own = F.when(F.col("name").isNull(), F.array().cast("array<string>")).otherwise(F.array("name"))
    held = nodes.select("file_path", "node_id", F.col("parent_id").alias("up")).join(names, ["file_path", "node_id"], "left").select("file_path", "node_id", "up", own.alias("scope"))
    held = kept(held, scratch_dir(nodes.sparkSession))
    while not held.where("up is not null").isEmpty():
        above = held.select("file_path", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("scope").alias("outer"))
        joined = held.join(above, ["file_path", "up"], "left")
        scope = F.when(F.col("outer").isNull(), F.col("scope")).otherwise(F.concat("outer", "scope"))
        held = kept(joined.select("file_path", "node_id", F.col("next").alias("up"), scope.alias("scope")), scratch_dir(nodes.sparkSession))
    return held.select("file_path", "node_id", "scope")


def select_spans(nodes: DataFrame, max_tokens: int) -> DataFrame:
    """The nodes to emit, with kind: of nodes(file_path, start, end, tokens, wanted, child_count, node_id, ...).

    A node is emitted if it is wanted and small or without children, or is
    another leaf, and no node around it was: intervals are nested, so by (start,
    end descending, node_id) that is a running maximum of the emitted ends.
    """
    small = F.col("wanted") & ((F.col("tokens") <= max_tokens) | (F.col("child_count") == 0))
    can = small | (F.col("child_count") == 0)
    order = Window.partitionBy("file_path").orderBy("start", F.desc("end"), "node_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(small & (F.col("end") > F.col("start")), F.col("end"))).over(order)
    marked = nodes.withColumns({"kind": F.when(small, "wanted").otherwise("gap"), "can": can, "reach": reach})
    return marked.where(F.col("can") & (F.col("reach").isNull() | (F.col("reach") <= F.col("start")))).drop("can", "reach")


def merge_spans(spans: DataFrame, files: DataFrame, target: int) -> DataFrame:
    """(file_path, part, span columns): each file's spans(file_path, span columns) folded up to the target."""
    packed = spans.groupBy("file_path").agg(F.collect_list(F.struct(*_SPAN_NAMES)).alias("spans"))
    joined = files.select("file_path", "content", "language").join(packed, "file_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, k, *s) for p, c, lang, ss in zip(*(b.column(x).to_pylist() for x in ("file_path", "content", "language", "spans")), strict=True) for k, s in enumerate(trees.fold([tuple(s[x] for x in _SPAN_NAMES) for s in ss], lang, c, target))]
            yield _table(rows, [pa.string(), pa.int32(), *[pa.int32()] * 5, pa.list_(pa.list_(pa.string())), pa.string()], ["file_path", "part", *_SPAN_NAMES])

    return joined.mapInArrow(run, f"file_path string, part int, {SPAN}")


def merge_spans_wide(spans: DataFrame, target: int) -> DataFrame:
    """As merge_spans, of spans(file_path, span columns, closing), for files whose spans no row should hold; closing: whether a gap only closes what is open.

    A gap belongs to the wanted span before it if a closing gap follows before the
    next one, or none does; else to the next. With running sums of tokens, where a
    chunk that begins at a span ends is a search in them, and the spans at which
    chunks begin are those reached from the first one by such steps: steps double,
    so a file of n chunks takes log2(n) joins.
    """
    spark = spans.sparkSession
    order = Window.partitionBy("file_path").orderBy("start", "end", F.desc("kind"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.col("kind") == "wanted"
    marked = spans.withColumn("turn", F.row_number().over(order)).withColumn("k", F.sum(wanted.cast("int")).over(upto))
    marked = marked.withColumn("all", F.max("k").over(Window.partitionBy("file_path"))).where("all > 0")
    closed = F.max(F.when(~wanted & F.col("closing"), F.col("turn"))).over(Window.partitionBy("file_path", "k"))
    back = (F.col("k") > 0) & ((F.col("turn") <= F.coalesce(closed, F.lit(0))) | (F.col("k") == F.col("all")))
    marked = marked.withColumn("after", ~wanted & back).withColumn("unit", F.col("k") + (~wanted & ~F.col("after")).cast("int"))
    units = marked.groupBy("file_path", "unit").agg(
        *[f(c).alias(c) for f, c in ((F.min, "start"), (F.max, "end"), (F.min, "start_row"), (F.max, "end_row"))],
        F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("after"), F.col("tokens")).otherwise(0)).alias("post"), F.max(F.when(wanted, F.struct(F.lit(1), "scope"))).alias("s"),
    )
    by_unit = Window.partitionBy("file_path").orderBy("unit")
    total = F.sum("tokens").over(by_unit.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    units = kept(units.withColumn("ends", total - F.col("post")).withColumn("begins", total - F.col("tokens")).withColumn("scope", F.col("s.scope")).drop("s"), scratch_dir(spark))

    # The next chunk begins at the first unit whose end is more than the target beyond this one's begin.
    points = units.select("file_path", F.col("ends").alias("at"), F.lit(0).alias("asks"), "unit").union(units.select("file_path", F.col("begins") + target, F.lit(1), "unit"))
    later = Window.partitionBy("file_path").orderBy("at", "asks").rowsBetween(1, Window.unboundedFollowing)
    found = points.withColumn("to", F.min(F.when(F.col("asks") == 0, F.col("unit"))).over(later)).where("asks = 1 and to is not null")
    step = kept(found.select("file_path", "unit", F.greatest("to", F.col("unit") + 1).alias("to")), scratch_dir(spark))
    starts = units.where("unit = 1").select("file_path", "unit")
    while not step.isEmpty():
        starts = kept(starts.union(starts.join(step, ["file_path", "unit"]).select("file_path", F.col("to").alias("unit"))).distinct(), scratch_dir(spark))
        on = step.select("file_path", F.col("unit").alias("to"), F.col("to").alias("far"))
        step = kept(step.join(on, ["file_path", "to"]).select("file_path", "unit", F.col("far").alias("to")), scratch_dir(spark))

    begun = units.join(starts.withColumn("first", F.lit(1)), ["file_path", "unit"], "left")
    part = F.sum(F.coalesce("first", F.lit(0))).over(by_unit.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    scopes = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("unit", "scope"))), lambda x: x["scope"])))
    out = begun.withColumn("part", part.cast("int")).groupBy("file_path", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("start_row").alias("start_row"), F.max("end_row").alias("end_row"), F.sum("tokens").cast("int").alias("tokens"), scopes.alias("scope"))
    return out.withColumn("kind", F.lit("wanted"))


def chunk_files(files: DataFrame, target: int = 256, most: int = 1024, node_source: str | DataFrame = "lines", counter: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """(id, file_path, start_line, end_line, content): the chunks of files(file_path, content, language).

    node_source: `lines`, `json`, or a node table (file_path, node columns).
    counter: token counts of a list of texts, instead of ceil(UTF-16 units / 4); it
    gets the distinct node texts of some files at once. Files without a wanted
    node, and null contents, give no chunks.
    """
    source = node_source if isinstance(node_source, str) else "table"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some, size = [], 0
            given = b.column("nodes").to_pylist() if "nodes" in b.schema.names else [None] * b.num_rows
            for p, c, lang, ns in zip(b.column("file_path").to_pylist(), b.column("content").to_pylist(), b.column("language").to_pylist(), given, strict=True):
                if c is None:
                    continue
                found = [[n[x] for x in _NODE] for n in ns] if ns is not None else trees.json_nodes(c) if source == "json" else trees.line_nodes(c)
                some.append((p, c, "text" if source == "lines" else lang, found))
                size += len(c)
                if size > FILE_CHARS:
                    yield made(some)
                    some, size = [], 0
            yield made(some)

    def made(some: list[tuple]) -> pa.RecordBatch:
        counts = trees.counted_slices([f[1:] for f in some], counter) if counter else None
        rows = []
        for p, c, lang, found in some:
            count = None if counts is None else (lambda i, j, c=c: counts[c[i:j]])
            rows += trees.chunks_of(p, c, lang, found, target, most, count)
        return _table(rows, _CHUNK_TYPES, ["id", "file_path", "start_line", "end_line", "content"])

    if isinstance(node_source, DataFrame):
        read = _with_nodes(files, node_source)
    else:
        read = files.select("file_path", "content", "language" if "language" in files.columns else F.lit("text").alias("language"))
    return read.mapInArrow(run, "id string, file_path string, start_line int, end_line int, content string")


def with_tokens(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes with the token count of their text. A file's nodes are beside its content once, as an array; its UTF-16 units are summed once, so a node costs the same wherever it lies."""
    own = [c for c in nodes.columns if c != "file_path"]
    packed = nodes.groupBy("file_path").agg(F.collect_list(F.struct(*own)).alias("nodes")).join(files.select("file_path", "content"), "file_path")
    packed = packed.select("file_path", "nodes", "content", F.transform("nodes", lambda n: n["start"]).alias("starts"), F.transform("nodes", lambda n: n["end"]).alias("ends"))
    schema = packed.select("file_path", "nodes").schema.add("tokens", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = []
            for c, starts, ends in zip(*(b.column(x).to_pylist() for x in ("content", "starts", "ends")), strict=True):
                count = trees.utf16_counter(c) if c is not None else lambda i, j: None
                tokens.append([count(i, j) for i, j in zip(starts, ends, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("file_path"), b.column("nodes"), pa.array(tokens, pa.list_(pa.int32()))], names=["file_path", "nodes", "tokens"])

    each = packed.mapInArrow(run, schema).select("file_path", F.explode(F.arrays_zip("nodes", "tokens")).alias("n"))
    return each.select("file_path", "n.nodes.*", "n.tokens")
