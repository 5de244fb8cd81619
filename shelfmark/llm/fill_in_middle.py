"""Fill-in-middle transformation by secondary sort.

A text is cut into units (a run of letters A-Z and a-z, or one other code point). Two of its unit
borders, drawn from a digest of its identifier, make a prefix, a middle and a suffix. The output
is the plain text, or the three sections behind their marks with the prefix first (psm) or the
suffix first (spm).

Sections leave as pieces of at most ``PIECE_UNITS`` units and ``PIECE_CHARS`` characters, keyed by
document and by their place in the output. One ``repartition`` and ``sortWithinPartitions`` (the
DataFrame form of repartitionAndSortWithinPartitions) brings a document's pieces together in
output order, so a task streams them into a digest, or into a text, and never sorts or holds more
than a piece by itself. For restoration the marks are looked for in that stream, also where one
lies across a border of pieces; what stands between them is sorted anew, inside the same partitions
and so without a second exchange, by its place in the source.

Cases: a null text is the empty text; an empty text, and one that has a mark in it, stays plain. A
null identifier is drawn for as the empty string. Rows that repeat each give their rows: a piece's
key has the task and the number of the row among its equals there. A very long text goes out in
pieces; only the row as it is read is whole. An empty table gives an empty table. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfmark.llm.common import map_batches, slices_by_size, text_of

PIECE_UNITS = 8192
PIECE_CHARS = 32_768
BATCH_CHARS = 1_000_000
# The marks of prefix, suffix and middle, and the sections' order in the source (fixed values).
MARKS = ("<P>", "<S>", "<M>")
SOURCE_ORDER = {"<P>": 0, "<M>": 1, "<S>": 2}
PLAIN, PSM, SPM = "plain", "psm", "spm"
KEY = ("key", "task", "nth")
FACTS = ("doc_id", "n", "form", "prefix_chars", "middle_chars")


def unit_starts(text: str) -> np.ndarray:
    """Where the units of a text begin, in code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (codes | 32) - np.uint32(ord("a")) < 26
    within = letter.copy()
    within[1:] &= letter[:-1]
    within[:1] = False
    return np.flatnonzero(~within)


def draw(ident: str, seed: int) -> list[int]:
    """Four numbers below 2**32 for an identifier."""
    digest = hashlib.sha256(f"{seed}:{ident}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _piece_borders(starts: np.ndarray, begin: int, end: int) -> list[int]:
    """Places from ``begin`` to ``end`` between which a section's pieces lie."""
    first, last = np.searchsorted(starts, (begin, end))
    borders = [begin, *starts[first + PIECE_UNITS : last : PIECE_UNITS].tolist(), end]
    out = [begin]
    for a, b in zip(borders, borders[1:]):
        out += [*range(a + PIECE_CHARS, b, PIECE_CHARS), b]
    return out


def cut(text: str, ident: str, seed: int, plain_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, list[str]]:
    """(units, form, prefix characters, middle characters, pieces in output order)."""
    starts = unit_starts(text)
    n = len(starts)
    h1, h2, h3, h4 = draw(ident, seed)
    if not n or h3 % 100 >= 100 - plain_percent or any(m in text for m in MARKS):
        form, sections = PLAIN, [("", 0, len(text))]
        prefix = middle = None
    else:
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (int(starts[i]) if i < n else len(text) for i in (a, b))
        prefix, middle = a, b - a
        form = SPM if h4 % 100 < spm_percent else PSM
        head, tail, gap = ("<P>", 0, a), ("<S>", b, len(text)), ("<M>", a, b)
        sections = [tail, head, gap] if form == SPM else [head, tail, gap]
    pieces = []
    for mark, begin, end in sections:
        borders = _piece_borders(starts, begin, end)
        parts = [text[i:j] for i, j in zip(borders, borders[1:])] or [""]
        pieces += [mark + parts[0], *parts[1:]]
    return n, form, prefix, middle, pieces


def output_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20
) -> DataFrame:
    """Pieces of the outputs, in any order: doc_id, key, task, nth, place, n, form, prefix_chars,
    middle_chars, piece. Key, task and nth name a row of ``docs``; place is the piece's in the
    output."""
    ident = F.col(id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    named = F.coalesce(ident.cast("string"), F.lit(""))
    rows = docs.select(
        ident.alias("doc_id"), named.alias("named"), F.xxhash64(named, text_of(text_col)).alias("key"), text_of(text_col).alias("content")
    )

    def make():
        task, seen = TaskContext.get().partitionId(), Counter()

        def step(batch):
            names, keys, texts = (batch.column(c).to_pylist() for c in ("named", "key", "content"))
            for start, end in slices_by_size(texts, BATCH_CHARS):
                origin, nth, place, pieces = [], [], [], []
                facts = {c: [] for c in ("n", "form", "prefix_chars", "middle_chars")}
                for i in range(start, end):
                    *values, parts = cut(texts[i], names[i], seed, plain_percent, spm_percent)
                    for name, value in zip(facts, values):
                        facts[name] += [value] * len(parts)
                    origin += [i] * len(parts)
                    nth += [seen[keys[i]]] * len(parts)
                    place += range(len(parts))
                    pieces += parts
                    seen[keys[i]] += 1
                yield {
                    "doc_id": batch.column("doc_id").take(pa.array(origin)), "key": [keys[i] for i in origin],
                    "task": [task] * len(origin), "nth": nth, "place": place, **facts, "piece": pieces,
                }

        return step

    return map_batches(rows, (
        f"doc_id {kind}, key long, task int, nth int, place int, n long, form string, "
        "prefix_chars long, middle_chars long, piece string"
    ), make)


def in_output_order(pieces: DataFrame) -> DataFrame:
    """A document's pieces next to each other in output order."""
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "place")


class Digest:
    """What a stream of pieces comes to: a SHA-256 of its UTF-8 bytes."""

    def __init__(self) -> None:
        self.state = hashlib.sha256()

    def add(self, piece: str) -> None:
        self.state.update(piece.encode("utf-8", "surrogatepass"))

    def value(self) -> str:
        return self.state.hexdigest()


class Joined:
    """What a stream of pieces comes to: the text."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def add(self, piece: str) -> None:
        self.parts.append(piece)

    def value(self) -> str:
        return "".join(self.parts)


class Sections:
    """Finds marks in a stream of pieces and says of each stretch which section it is."""

    def __init__(self, form: str) -> None:
        self.plain, self.order, self.held = form == PLAIN, 0, ""

    def add(self, piece: str, last: bool = False) -> Iterator[tuple[int, str]]:
        if self.plain:
            if piece:
                yield 0, piece
            return
        text, begin = self.held + piece, 0
        while True:
            at = min((p for p in (text.find(m, begin) for m in MARKS) if p >= 0), default=-1)
            if at < 0:
                break
            if at > begin:
                yield self.order, text[begin:at]
            self.order, begin = SOURCE_ORDER[text[at : at + 3]], at + 3
        # The end may be the beginning of a mark.
        keep = len(text) if last else max(begin, len(text) - 2)
        if keep > begin:
            yield self.order, text[begin:keep]
        self.held = text[keep:]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        for i, key in enumerate(zip(*(columns[c] for c in KEY))):
            yield key, {c: v[i] for c, v in columns.items()}


def _stream(df: DataFrame, schema: str, fold: Callable[[Iterator[tuple[tuple, dict]]], Iterator[dict]]) -> DataFrame:
    """The sorted rows of ``df`` through ``fold``, which gives rows; they leave in small batches."""
    out_type = StructType.fromDDL(schema)

    def run(batches):
        target, held, size = to_arrow_schema(out_type), [], 0
        for row in fold(_rows(batches)):
            held.append(row)
            size += 100 + len(row.get("piece") or row.get("output") or row.get("restored") or "")
            if size > 4_000_000 or len(held) == 1000:
                yield pa.RecordBatch.from_pylist(held, schema=target)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=target)

    return df.mapInArrow(run, out_type)


def assembled(pieces: DataFrame, sink: type[Digest] | type[Joined] = Joined) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output (text, or its digest)."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def fold(rows):
        key = first = out = None
        for found, row in rows:
            if found != key:
                if out:
                    yield first | {"output": out.value()}
                key, out, first = found, sink(), {c: row[c] for c in FACTS}
            out.add(row["piece"])
        if out:
            yield first | {"output": out.value()}

    return _stream(
        in_output_order(pieces), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string", fold
    )


def restored(pieces: DataFrame, sink: type[Digest] | type[Joined] = Joined) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, and
    restored, the source text (or its digest) rebuilt from output and form alone."""
    kind = pieces.schema["doc_id"].dataType.simpleString()
    facts = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long"

    def find(rows):
        """Stretches of the outputs with their section, and one row of facts of each document."""
        key = first = digest = sections = None
        nth = 0

        def end():
            nonlocal nth
            for order, piece in sections.add("", last=True):
                yield at | {"section": order, "stretch": nth, "piece": piece}
                nth += 1
            yield at | first | {"section": -1, "stretch": 0, "output_sha256": digest.value()}

        for found, row in rows:
            if found != key:
                if key is not None:
                    yield from end()
                key, digest, sections, nth = found, Digest(), Sections(row["form"]), 0
                at = dict(zip(KEY, key))
                first = {c: row[c] for c in FACTS}
            digest.add(row["piece"])
            for order, piece in sections.add(row["piece"]):
                yield at | {"section": order, "stretch": nth, "piece": piece}
                nth += 1
        if key is not None:
            yield from end()

    def join(rows):
        first = out = None
        for _, row in rows:
            if row["section"] < 0:
                if out:
                    yield first | {"restored": out.value()}
                first, out = {c: row[c] for c in (*FACTS, "output_sha256")}, sink()
            else:
                out.add(row["piece"])
        if out:
            yield first | {"restored": out.value()}

    stretches = _stream(
        in_output_order(pieces),
        f"key long, task int, nth int, section int, stretch int, piece string, {facts}, output_sha256 string", find,
    )
    return _stream(
        stretches.sortWithinPartitions(*KEY, "section", "stretch"), f"{facts}, output_sha256 string, restored string", join
    )

