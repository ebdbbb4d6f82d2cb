"""Fixed schemas of the index tables and of node tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType())}


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split(" ") for x in text.split(", "))])


DOCUMENTS = _struct("file_path string, hash string, created_at timestamp, updated_at timestamp")
CHUNKS = _struct("id string, file_path string, start_line int, end_line int, content string, created_at timestamp")
EMBEDDINGS = _struct("chunk_id string, embedding array<float>, created_at timestamp")
#: The newest version of a path that a stream has brought; ties of `arrived` go by the hash.
ARRIVALS = _struct("file_path string, arrived long, hash string")
FILES = _struct("file_path string, content string, hash string, language string")
#: A syntax tree: parent pointers and nested code point intervals, 0-based rows, `field` as the parent names the child.
NODE = "node_id int, parent_id int, field string, type string, start int, end int, start_row int, end_row int, child_count int"
SPAN = "start int, end int, start_row int, end_row int, tokens int, scope array<array<string>>, kind string"
CHUNK = "id string, file_path string, start_line int, end_line int, content string"
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "embeddings": EMBEDDINGS, "arrivals": ARRIVALS}
