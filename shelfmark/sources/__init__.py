"""Reading corpora and sheets, and writing, listing and restoring index snapshots."""

from shelfmark.sources.exports import export_contents, folder_contents
from shelfmark.sources.files import corpus_files, read_text_files, scan_files
from shelfmark.sources.reconcile import reconcile, reconcile_tables, schema_changes, schema_difference
from shelfmark.sources.sheets import render_cells, sheet_texts
from shelfmark.sources.snapshots import (
    blobs_under, latest_snapshot, new_snapshot_id, newest_snapshot, restore_snapshot, snapshot_times,
    write_manifest, write_snapshot, write_table,
)
