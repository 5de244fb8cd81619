"""The tables of an index, as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()

FILES = _table(("path", _S), ("name", _S), ("folder", _S), ("ext", _S), ("text", _S))
UNITS = _table(("path", _S), ("ord", _I), ("text", _S))
CELLS = _table(("path", _S), ("row", _I), ("col", _I), ("value", _S))
BLOBS = _table(("name", _S), ("last_modified", T.TimestampType()))

DOCUMENTS = _table(
    ("id", _S), ("name", _S), ("file_path", _S), ("folder", _S), ("doc_type", _S),
    ("hash", _S), ("summary", _S), ("vector", VECTOR), ("created_ms", _L),
)
SEGMENTS = _table(
    ("id", _S), ("document_id", _S), ("ord", _I), ("text", _S),
    ("vector", VECTOR), ("created_ms", _L),
)
FOLDERS = _table(
    ("id", _S), ("name", _S), ("file_path", _S), ("parent", _S), ("depth", _I),
    ("hash", _S), ("summary", _S), ("vector", VECTOR), ("created_ms", _L),
)

INDEX_TABLES = {"documents": DOCUMENTS, "segments": SEGMENTS, "folders": FOLDERS}
