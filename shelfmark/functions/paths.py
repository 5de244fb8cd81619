"""Names, paths and folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings taken in, the engine's own export, the prefix of lock files,
# and the tag inside snapshot names.
FILE_TYPES = (".docx", ".pdf", ".pptx", ".xlsx", ".txt", ".rtf")
AVOID_NAMES = ("Folder_Contents.xlsx",)
LOCK_PREFIX = "~$"
SNAPSHOT_TAG = "10_391_92_6"


def _any(conditions: Sequence[Column]) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def has_file_type(name: Column, file_types: Sequence[str] = FILE_TYPES) -> Column:
    return _any([name.endswith(ending) for ending in file_types])


def is_lock_file(name: Column) -> Column:
    return name.startswith(LOCK_PREFIX)


def accepted_name(
    name: Column,
    file_types: Sequence[str] = FILE_TYPES,
    avoid_names: Sequence[str] = AVOID_NAMES,
) -> Column:
    """A known file ending, not the engine's own export, not an editor's lock file."""
    return has_file_type(name, file_types) & ~name.isin(*avoid_names) & ~is_lock_file(name)


def ignored_folder(folder: Column, ignore: Sequence[str]) -> Column:
    """Whether a folder lies under an ignored path or has an ignored name above it.

    An entry is a path prefix or the bare name of a folder at any level. Empty entries
    are dropped; they would match every path.
    """
    entries = [entry for entry in ignore if entry]
    if not entries:
        return F.lit(False)
    by_name = F.arrays_overlap(F.split(folder, "/"), F.array(*[F.lit(e) for e in entries]))
    return _any([folder.startswith(entry) for entry in entries]) | by_name


def document_type(path: Column) -> Column:
    """The text after the last dot of a path."""
    return F.substring_index(path, ".", -1)


def base_name(path: Column) -> Column:
    """The last part of a path."""
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """The path without its last part; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestor_paths(folder: Column) -> Column:
    """A folder and everything above it, top first, without the empty path."""
    parts = F.split(folder, "/")
    paths = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    return F.filter(paths, lambda p: p != "")


def snapshot_name(path: Column, date: Column, suffix: Column) -> Column:
    """``path_tag_date-suffix`` with blanks as ``_`` and only ``[a-z0-9_-]`` kept."""
    raw = F.concat(
        path, F.lit(f"_{SNAPSHOT_TAG}_"), F.date_format(date, "yyyy-MM-dd"), F.lit("-"), suffix
    )
    return F.regexp_replace(F.replace(raw, F.lit(" "), F.lit("_")), "[^a-z0-9_-]", "")
