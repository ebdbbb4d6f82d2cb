"""Column functions over paths, texts and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by extension, and what closes a syntax in each.
EXTENSIONS = {"ts": "typescript", "tsx": "tsx", "json": "json", "js": "javascript", "mjs": "javascript", "cjs": "javascript"}
CLOSING = {
    "typescript": [r"^[\s)\]}>]+$"],
    "javascript": [r"^[\s)\]}>]+$"],
    "tsx": [r"^[\s)\]}>]+$", r"^\s*/>", r"^\s*</[a-zA-Z_$][\w$.:-]*\s*>"],
    "json": [r"^[\s\]},]+$"],
}


def tag_language(df: DataFrame, path_col: str, extensions: dict[str, str] | None = None) -> DataFrame:
    """Adds `language` by the text after the last dot (case counts) and drops rows of other extensions."""
    known = EXTENSIONS | (extensions or {})
    extension = F.element_at(F.split(F.col(path_col), r"\."), -1)
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return df.withColumn("language", F.element_at(table, extension)).where(F.col("language").isNotNull())


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def token_count(text: Column, counter: str | None = "simple") -> Column:
    """ceil(UTF-16 units / 4); or a counter of the caller's: a function from column to column."""
    if callable(counter):
        return counter(text)
    return F.ceil(F.octet_length(F.encode(text, "UTF-16BE")) / 8).cast("int")


def is_closing_syntax(text: Column, language: Column) -> Column:
    """Whether a text only closes what is open, by language; false for other languages and for empty text."""
    out = F.lit(False)
    for name, patterns in CLOSING.items():
        out = F.when(language == name, text.rlike("|".join(patterns))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def normalize_path(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def render_header(file_path: Column, scope: Column) -> Column:
    """The comment block above a chunk: its path and its scopes, those that are empty left out."""
    items = F.filter(F.transform(scope, lambda s: F.array_join(s, " -> ")), lambda s: s != "")
    path = F.concat(F.lit("# filePath: "), file_path, F.lit("\n"))
    scopes = F.concat(F.lit("# scope:\n"), F.array_join(F.transform(items, lambda s: F.concat(F.lit("#   - "), s)), "\n"), F.lit("\n"))
    return F.concat(path, F.when(F.size(items) > 0, scopes).otherwise(""), F.lit("---\n"))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def l2_normalize(vector: Column) -> Column:
    """The vector over its norm; null for a zero vector."""
    n = norm(vector)
    return F.when(n > 0, F.transform(vector, lambda x: x / n))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; null where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return 1 - F.try_divide(dot, norm(a) * norm(b))


def parse_embedding(text: Column) -> Column:
    """JSON text as a number array; null where it is no non-empty array of numbers."""
    parsed = F.from_json(text, "array<double>", {"mode": "PERMISSIVE"})
    return F.when((F.size(parsed) > 0) & ~F.exists(parsed, lambda x: x.isNull()), parsed)


def format_embedding(vector: Column) -> Column:
    return F.to_json(vector)


def parsed_or_raise(df: DataFrame, column: str, into: str) -> DataFrame:
    """df with `into`; an invalid text raises when it is read."""
    return df.withColumn(into, F.coalesce(parse_embedding(F.col(column)), F.raise_error(F.concat(F.lit("not an embedding: "), F.coalesce(F.col(column), F.lit("null")))).cast("array<double>")))


def rejected_embeddings(df: DataFrame, column: str) -> DataFrame:
    """The rows whose text is no embedding."""
    return df.where(parse_embedding(F.col(column)).isNull())


def check_dimensions(df: DataFrame, n: int, cap: int | None = None, column: str = "embedding") -> DataFrame:
    """df as it is; a vector of another width than min(n, cap) raises when it is read."""
    width = min(n, cap) if cap else n
    wrong = F.raise_error(F.concat(F.lit(f"an embedding is not of width {width}: "), F.size(column).cast("string")))
    return df.withColumn(column, F.when(F.size(column) == width, F.col(column)).otherwise(wrong.cast(df.schema[column].dataType)))


def read_lines(files: DataFrame, requests: DataFrame) -> DataFrame:
    """(file_path, text): lines offset .. offset + limit - 1 of each request, numbered from 1; only requested files are split."""
    lines = F.when(F.col("content") == "", F.array().cast("array<string>")).otherwise(F.split("content", "\r?\n"))
    first = F.greatest(F.col("offset"), F.lit(1))
    shown = F.when(F.col("limit") > 0, F.slice("lines", first, F.col("limit"))).otherwise(F.array().cast("array<string>"))
    numbered = F.transform(shown, lambda x, i: F.concat((i + F.col("first")).cast("string"), F.lit(": "), x))
    joined = files.select("file_path", "content").join(requests, "file_path")
    return joined.select("file_path", lines.alias("lines"), first.alias("first"), "limit", "offset").select("file_path", F.array_join(numbered, "\n").alias("text"))
