"""Column functions: everything here builds built-in Spark expressions."""

from shelfmark.functions.paths import (
    accepted_name, base_name, ancestor_paths, document_type, ignored_folder, parent_path, snapshot_name,
)
from shelfmark.functions.text import (
    break_to_html, count_words, document_hash, document_id, document_prompt, drop_repeat_lines,
    embedding_input, extracted_text, first_words, folder_hash, folder_id, folder_prompt,
    is_substantial, join_broken_lines, json_flag, lead_summary, let, repair_text, segment_id,
    sentences, split_lines, summary_or_default, truncate_words, words,
)
from shelfmark.functions.vectors import cosine_distance, l2_norm
