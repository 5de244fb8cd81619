"""Folder trees, listed and read on the executors.

Spark's own file sources list on the driver and leave out empty files and names that start
with ``_`` or ``.``. Here folders are rows: a task lists the folders it is dealt and those
below them, up to a number of folders, and hands the rest on to the next round, in which they
are spread over all tasks again. Rounds are written to the shared folder, so the driver holds
no path and a lost executor costs the folders of its tasks. Only a listing of few files ends as a
local table, and leaves nothing in the shared folder.

Roots are local paths, ``file:`` URIs (a folder that all executors mount), or URIs of a store
that ``pyarrow.fs`` opens (``s3``, ``gs``, ``hdfs``, ``abfs``).
"""

from __future__ import annotations

import datetime as dt
import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.paths import ignored_folder
from shelfmark.runtime import drop_scratch, new_scratch_path

FOLDERS_A_TASK = 256
WAITING = 10_000
BATCH_ROWS = 4_096
# Files of a listing that the driver holds instead of the shared folder, at most.
LOCAL_FILES = 4_096
BATCH_BYTES = 4 << 20
TASK_BYTES = 512 << 20
TASK_FILES = 20_000
LARGEST = (1 << 31) - (1 << 20)

_ENTRIES = "path string, is_folder boolean, length long, last_modified timestamp"
_ARROW_ENTRIES = pa.schema([
    ("path", pa.string()), ("is_folder", pa.bool_()), ("length", pa.int64()),
    ("last_modified", pa.timestamp("us", "UTC")),
])
_ARROW_CONTENTS = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])

Entry = tuple[str, bool, int, dt.datetime | None]


def normal_root(root: str) -> str:
    """``file:/a/`` and ``file:///a`` as ``/a``; other schemes stay; no slash at the end."""
    plain = re.sub("^file:/+", "/", root)
    return plain.rstrip("/") or "/"


def _store(path: str) -> tuple[pafs.FileSystem, str, str] | None:
    """(file system, prefix of its paths, path inside) of a URI, None for a local path."""
    if "://" not in path:
        return None
    system, inside = pafs.FileSystem.from_uri(path)
    return system, path[: len(path) - len(inside.lstrip("/"))], inside


def _readable(name: str) -> str:
    """A name that is not UTF-8 with replacement marks; such a file is listed, not read."""
    return os.fsencode(name).decode("utf-8", "replace")


def store_entries(system: pafs.FileSystem, prefix: str, inside: str) -> Iterator[Entry]:
    for info in system.get_file_info(pafs.FileSelector(inside)):
        yield prefix + info.path.lstrip("/"), info.type == pafs.FileType.Directory, info.size or 0, info.mtime


def _local_entries(folder: str) -> Iterator[Entry]:
    with os.scandir(folder) as found:
        for entry in found:
            # A link to a folder is not followed: links may form a circle.
            if entry.is_dir(follow_symlinks=False):
                yield entry.path, True, 0, None
            elif entry.is_file():
                state = entry.stat()
                yield _readable(entry.path), False, state.st_size, dt.datetime.fromtimestamp(state.st_mtime, dt.timezone.utc)


def _entries(folder: str, root: str) -> Iterator[Entry]:
    store = _store(folder)
    try:
        yield from _local_entries(folder) if store is None else store_entries(*store)
    except FileNotFoundError:
        if folder == root:
            raise
        # A folder that went away since its parent was listed has no files.


def _listing(entries: list[Entry]) -> pa.RecordBatch:
    columns = zip(*entries, strict=True) if entries else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, _ARROW_ENTRIES, strict=True)], schema=_ARROW_ENTRIES
    )


def _walk(folder: str, root: str, folders: int) -> Iterator[Entry]:
    """Files below ``folder``, and the folders that are left for the next round.

    Folders whose names are not UTF-8 cannot be handed on; they are walked here.
    """
    waiting, listed = [folder], 0
    while waiting and listed < folders:
        listed += 1
        for entry in _entries(waiting.pop(), root):
            if not entry[1]:
                yield entry
            elif len(waiting) < WAITING or _readable(entry[0]) != entry[0]:
                waiting.append(entry[0])
            else:
                yield entry
    for path in waiting:
        if _readable(path) == path:
            yield path, True, 0, None
        else:
            yield from _walk(path, root, folders)


def list_tree(
    spark: SparkSession, root: str, ignore: Sequence[str] = (), folders_a_task: int = FOLDERS_A_TASK
) -> DataFrame:
    """(path, length, last_modified) of every file below ``root``, empty and hidden ones too.

    Ignored folders are not entered. Links to files count as files, links to folders are not
    followed. A missing root is an error; a folder that goes away meanwhile is empty. The
    listing is made by this call, as for any Spark file source.
    """
    root = normal_root(root)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[Entry] = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for entry in _walk(folder, root, folders_a_task):
                    ready.append(entry)
                    if len(ready) == BATCH_ROWS:
                        yield _listing(ready)
                        ready = []
        yield _listing(ready)

    out = new_scratch_path(spark, "listing")
    pending, n_round = spark.createDataFrame([(root,)], "path string"), 0
    while True:
        stored = f"{out}/round={n_round}"
        pending.mapInArrow(walk, _ENTRIES).write.parquet(stored)
        left = spark.read.schema(_ENTRIES).parquet(stored).where("is_folder")
        left = left.where(~ignored_folder(F.col("path"), ignore)).select("path")
        n_left = left.count()
        if not n_left:
            break
        pending = left.repartition(min(n_left, 4 * spark.sparkContext.defaultParallelism))
        n_round += 1
    files = spark.read.schema(_ENTRIES).parquet(out).where("not is_folder")
    files = files.select("path", "length", "last_modified")
    few = files.limit(LOCAL_FILES + 1).collect()
    if len(few) > LOCAL_FILES:
        return files
    drop_scratch(spark, out)
    return spark.createDataFrame(few, files.schema)


def _content(path: str, length: int) -> tuple[bytes | None, str | None]:
    if length > LARGEST:
        return None, f"{length} bytes are more than a value holds"
    store = _store(path)
    try:
        if store is None:
            with open(path, "rb") as file:
                return file.read(), None
        with store[0].open_input_stream(store[2]) as stream:
            return stream.read(), None
    except OSError as problem:
        return None, f"not readable: {problem.strerror or problem}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW_CONTENTS)]
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW_CONTENTS)

    ready, held = [], 0
    for found in batches:
        for path, length in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
            if ready and held + length > BATCH_BYTES:
                yield batch(ready)
                ready, held = [], 0
            ready.append((path, *_content(path, length)))
            held += length
            if len(ready) == BATCH_ROWS:
                yield batch(ready)
                ready, held = [], 0
    yield batch(ready)


def read_contents(files: DataFrame) -> DataFrame:
    """(path, content, error) of each listed file (path, length).

    The listing is dealt out so that a task reads some 512 MB or 20,000 files, whatever
    folder they lie in, and holds 4 MB of them or one file at a time. A file that went away, may not be read or exceeds a value gives a null
    content and the reason.
    """
    total = files.agg(F.sum(F.when(F.col("length") <= LARGEST, F.col("length"))).alias("n_bytes"), F.count(F.lit(1)).alias("n")).first()
    parts = 1 + max((total["n_bytes"] or 0) // TASK_BYTES, total["n"] // TASK_FILES)
    parts = max(parts, min(total["n"], files.sparkSession.sparkContext.defaultParallelism))
    return files.select("path", "length").repartition(parts).mapInArrow(
        _read, "path string, content binary, error string"
    )
