"""Documents into overlapping segments of whole sentences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import SENTENCE_GAP, is_substantial, segment_id

# Characters in a segment, characters carried over, what joins sentences.
CHUNK_SIZE, CHUNK_OVERLAP = 450, 30
JOINER = "\n\n"
# Bytes of texts that a Python worker cuts at once, at most about; a text is not split up.
BYTES_AT_ONCE = 2 << 20


def chunk_text(
    df: DataFrame,
    text: str = "text",
    out: str = "chunk",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """One row (.., ord, chunk) per segment of each text; the other columns are kept.

    Sentences are packed in order into segments of at most ``size`` characters; the last
    ``overlap`` characters' worth of sentences open the next one. A sentence longer than
    ``size`` is a segment of its own. The fold over sentences is sequential within one text
    and independent between texts, so it runs in Arrow batches where the text already is;
    nothing is shuffled for it.
    """
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType(
        [*kept, T.StructField("ord", T.IntegerType()), T.StructField(out, T.StringType())]
    )
    joiner, width = JOINER, len(JOINER)

    def pack(parts: list[str]) -> list[str]:
        chunks, first, held = [], 0, 0
        for here, part in enumerate(parts):
            need = len(part)
            if here > first and held + width + need > size:
                chunks.append(joiner.join(parts[first:here]))
                while first < here and (held > overlap or held + need + width > size):
                    held -= len(parts[first]) + (width if first + 1 < here else 0)
                    first += 1
            held += need + (width if here > first else 0)
        chunks.append(joiner.join(parts[first:]))
        return [c for c in map(str.strip, chunks) if c]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # The rule of functions.text.sentences, with lengths in characters.
        gap = re.compile(SENTENCE_GAP)

        def segments(part: pa.RecordBatch) -> pa.RecordBatch:
            source, places, chunks = [], [], []
            for row, value in enumerate(part.column(len(kept))):
                value = value.as_py()
                packed = pack([p for p in gap.split(value) if p]) if value else []
                source += [row] * len(packed)
                places += range(len(packed))
                chunks += packed
            rows = pa.array(source, pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    *[part.column(i).take(rows) for i in range(len(kept))],
                    pa.array(places, pa.int32()),
                    pa.array(chunks, pa.string()),
                ],
                names=schema.names,
            )

        for batch in batches:
            # Some texts of a batch at a time: what a worker holds does not grow with its partition.
            held = np.cumsum(pc.binary_length(batch.column(len(kept))).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            starts = [*np.flatnonzero(np.diff(held // BYTES_AT_ONCE, prepend=-1)), batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                yield segments(batch.slice(start, end - start))

    return df.select(*[f.name for f in kept], text).mapInArrow(cut, schema)


def chunk_documents(
    documents: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    keep: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Segments of ``documents`` (id, doc_type, text, ...): adds (segment_id, ord, segment).

    Spreadsheets give none. ``keep`` is an optional test for a segment, such as
    :func:`shelfmark.functions.is_substantial`; where it is null the segment stays. ``ord``
    is the place among all segments of the document, dropped ones included.
    """
    prose = documents.where(F.col("doc_type") != "xlsx")
    segments = chunk_text(prose, "text", "segment", size, overlap)
    if keep is not None:
        segments = segments.where(F.coalesce(keep(F.col("segment")), F.lit(True)))
    return segments.withColumn("segment_id", segment_id(F.col("id"), F.col("ord")))


def keep_substantial(segments: DataFrame, column: str = "segment") -> DataFrame:
    """Drop gibberish, headings and bare links; keep what cannot be judged."""
    return segments.where(is_substantial(F.col(column)))


def drop_rejected(segments: DataFrame, column: str = "segment_id") -> DataFrame:
    """Drop segments whose insert gave no id."""
    return segments.where(F.col(column).isNotNull())


def drop_repeat_units(units: DataFrame, block: int = 10_000) -> DataFrame:
    """Drop a unit (path, ord, text) equal to the one just before it in its document.

    ``ord`` runs without gaps. Documents are compared in blocks of ``block`` units, each
    with the unit before it as context, so a giant document is spread over many tasks.
    """
    from pyspark.sql import Window as W

    number = F.floor(F.col("ord") / block).cast("long")
    last_of_block = F.col("ord") % block == block - 1
    placed = units.withColumn(
        "_block", F.explode(F.when(last_of_block, F.array(number, number + 1)).otherwise(F.array(number)))
    )
    before = F.lag("text").over(W.partitionBy("path", "_block").orderBy("ord"))
    return (
        placed.withColumn("_before", before)
        .withColumn("_first", F.lag(F.lit(True)).over(W.partitionBy("path", "_block").orderBy("ord")).isNull())
        .where((number == F.col("_block")) & (F.col("_first") | ~F.col("text").eqNullSafe(F.col("_before"))))
        .select(units.columns)
    )
