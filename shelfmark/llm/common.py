"""Small helpers the operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
# Runs of anything but ASCII white space: blank and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` does not have (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def keyed(value: Column) -> Column:
    """A string key in code point order with null as a value of its own, last."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("~"))


def map_batches(
    df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict] | dict]]
) -> DataFrame:
    """Arrow batches of ``df`` through a function that each task makes once with ``make``.

    The function gives one dict of columns per batch, or several. Rows here are whole texts, so
    the session's batches are set to ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes (or one row)
    at most: a task then holds a few megabytes of them on either side, not a few hundred.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(ROWS_PER_BATCH)) <= BATCH_ROWS:
        conf.set(ROWS_PER_BATCH, BATCH_ROWS)
    if not re.fullmatch("[1-9][0-9]*b?", n_bytes := conf.get(BYTES_PER_BATCH)) or int(n_bytes.rstrip("b")) > BATCH_BYTES:
        conf.set(BYTES_PER_BATCH, BATCH_BYTES)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def run(batches):
        step = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = step(batch)
            for columns in [out] if isinstance(out, dict) else out:
                yield pa.RecordBatch.from_arrays(
                    [
                        c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                        for f, c in ((f, columns[f.name]) for f in target)
                    ],
                    schema=target,
                )

    return df.mapInArrow(run, schema)


def slices_by_size(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` with about ``limit`` characters each, one text at least."""
    yield from _slices([len(t) for t in texts], limit)


def shares(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts with up to ``limit`` bytes of a text or elements of a list each, or one row."""
    values = batch.column(batch.schema.get_field_index(column))
    measure = pc.list_value_length if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length
    for start, end in _slices(pc.fill_null(measure(values), 0).to_pylist(), limit):
        yield batch.slice(start, end - start)


def _slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
