"""DataFrame-in, DataFrame-out operators of the index."""

from shelfmark.operators.changes import (
    cascade_delete, changed_or_new, classify, gone_rows, index_counts, insert, stale_rows,
    unchanged_documents, upsert, without,
)
from shelfmark.operators.cells import compared, nearest_in_cells, recall, write_cells
from shelfmark.operators.chunking import (
    chunk_documents, chunk_text, drop_rejected, drop_repeat_units, keep_substantial,
)
from shelfmark.operators.enrich import (
    BatchModel, KeySentences, LeadSummary, Provider, classify_segments, embed, fallback, hashed_vectors, summarise,
)
from shelfmark.operators.folders import (
    ancestors, beginning_texts, content_marks, count_items, nonempty_summaries, rollup, stale_folders,
    summary_text_parts, upsert_folders, with_children,
)
from shelfmark.operators.grouping import child_pages, hot_keys, number_rows
from shelfmark.operators.listing import (
    document_segments, folder_document_ids, limit_rows, linked_documents, list_documents, list_folders,
    list_segments, lookup, segments_of,
)
from shelfmark.operators.search import (
    flat_documents, flat_folders, flat_segments, folder_pages, nearest, search_context,
    search_documents, search_folders, search_segments, segment_documents, top_k,
)
