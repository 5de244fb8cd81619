"""Whole runs put together from the operators."""

from shelfmark.plans.index import (
    Settings, document_records, extracted, index_to_snapshot, refresh_snapshot, run_index, segment_records,
)
