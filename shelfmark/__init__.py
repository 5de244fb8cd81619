"""Shelfmark: file corpora as searchable tables, on Spark."""

from shelfmark.operators import (
    lookup, list_documents, list_folders, list_segments, nearest, search_context,
    search_documents, search_folders, search_segments,
)
from shelfmark.plans import Settings, index_to_snapshot, refresh_snapshot, run_index
from shelfmark.runtime import session
from shelfmark.sources import (
    export_contents, read_text_files, restore_snapshot, scan_files, write_snapshot,
)
