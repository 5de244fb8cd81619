r"""The same queries as DuckDB SQL over the same tables.

Each query names the shared views it needs; ``_sql`` puts them in front as common table
expressions. DuckDB's regular expressions have no look-around, hence the replacements with
groups and marks.
"""

from __future__ import annotations

from shelfmark.functions.text import (
    ANSWER_INSTRUCTIONS, DOCUMENT_INSTRUCTIONS, EXCERPT_NOTE, FOLDER_INSTRUCTIONS, NO_DOCUMENT_SUMMARY, NO_FOLDER_SUMMARY,
)
from shelfmark.operators.folders import EMPTY_FOLDER

NL = "chr(10)"
SEP = f"'###' || {NL}"
GAP = r"[ \t\n\r\f]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{GAP}'), lambda w: w <> '')"


def first_words(text: str, n: int) -> str:
    return f"array_to_string({words(text)}[1:{n}], ' ')"


def lead(text: str, opening: str, n: int) -> str:
    head = first_words(text, n)
    return f"CASE WHEN {head} <> '' THEN '{opening}' || {head} END"


def hashed(text: str, dimensions: int = 256) -> str:
    """The places of a text's words, by the first digits of each word's MD5."""
    found = rf"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"list_transform({found}, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % {dimensions})"


def hashed_vectors(name: str, source: str, key: str, text: str, dimensions: int = 256) -> dict[str, str]:
    """Views with the vectors of the texts of ``source``."""
    return {
        f"{name}_n": f"""
            SELECT {key}, place, count(*) - 1 AS n FROM (
              SELECT {key}, unnest(list_concat(range({dimensions}), {hashed(text, dimensions)})) AS place FROM {source}) GROUP BY ALL""",
        name: f"""
            SELECT {key}, list((CASE WHEN norm > 0 THEN n / norm ELSE 0 END)::FLOAT ORDER BY place) AS vector FROM (
              SELECT *, sqrt(sum(n * n) OVER (PARTITION BY {key})) AS norm FROM {name}_n) GROUP BY {key}""",
    }


def key_sentences(name: str, source: str, key: str, opening: str, n: int = 100, longest: int = 40) -> dict[str, str]:
    """Views that summarise the texts of ``source`` (key, text): units, their words, ranks."""
    return {
        f"{name}_u": rf"""
            SELECT {key}, list_filter(all_u, lambda x, i: list_position(all_u, x) = i) AS u FROM (
            SELECT {key}, list_filter(list_transform(flatten(list_transform(
              list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1) || '|\n+'),
                lambda s: {words('s')}),
              lambda w: list_transform(range(1, greatest(len(w), 1) + 1, {longest}), lambda i: array_to_string(w[i:i + {longest - 1}], ' ')))),
              lambda u: regexp_replace(u, '^[# ]+|[# ]+$', '', 'g')), lambda u: u <> '') AS all_u FROM {source})""",
        f"{name}_t": rf"""
            SELECT {key}, ord, n, total, unnest(CASE WHEN len(t) > 0 THEN t ELSE [NULL] END) AS term FROM (
              SELECT {key}, ord, total, len(string_split(unit, ' ')) AS n,
                list_distinct(list_filter(regexp_split_to_array(lower(unit), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 4)) AS t
              FROM (SELECT {key}, len(u) AS total, unnest(u) AS unit, generate_subscripts(u, 1) AS ord FROM {name}_u))""",
        f"{name}_r": f"""
            SELECT *, sum(n) OVER (PARTITION BY {key} ORDER BY ord = 1 DESC, ord = total DESC, score DESC, ord) AS upto FROM (
              SELECT {key}, ord, n, total, floor(1000 * sum(CASE WHEN c >= 2 AND 2 * c <= total THEN c ELSE 0 END) / n) AS score FROM (
                SELECT *, count(term) OVER (PARTITION BY {key}, term) AS c FROM {name}_t) GROUP BY {key}, ord, n, total)""",
        name: f"""
            SELECT {key}, '{opening}' || string_agg(u[ord], ' ' ORDER BY ord) AS summary
            FROM {name}_r JOIN {name}_u USING ({key}) WHERE upto <= {n} GROUP BY {key}""",
    }


def join_broken(text: str) -> str:
    return rf"regexp_replace({text}, '\n(\p{{Ll}}|ª|º)', '\1', 'g')"


def drop_repeats(text: str) -> str:
    lines = f"string_split({text}, {NL})"
    return f"array_to_string(list_filter({lines}, lambda x, i: i = 1 OR x <> {lines}[i - 1]), {NL})"


def substantial(text: str) -> str:
    readable = rf"length(regexp_replace({text}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
    visible = rf"length(regexp_replace({text}, '[ \t\n\r\f.,;:]', '', 'g'))"
    link = rf"regexp_matches({text}, '^[ \t\n\r\f]*(https?://|www\.)[^ \t\n\r\f]+[ \t\n\r\f]*$')"
    return (
        f"coalesce(NOT ({link} OR {readable} < {visible} * 0.8 "
        f"OR (len(regexp_split_to_array(trim({text}), '{GAP}')) < 4 AND NOT regexp_matches({text}, '[.!?]'))), true)"
    )


def page(ident: str, n: str) -> str:
    return f"CASE WHEN {n} > 4096 THEN substr({ident}, 1, length(to_hex({n} // 4096))) ELSE '' END"


def bars(value: str, order: str) -> str:
    return f"coalesce(string_agg({value}, ' | ' ORDER BY {order}), '')"


def distance(a: str, b: str) -> str:
    return f"round(1 - list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


def mark(summary: str) -> str:
    """A digest over a group's summaries, whatever their order."""
    lanes = " || ':' || ".join(
        f"sum(('0x' || substr(sha256({summary}), {1 + 15 * i}, 15))::BIGINT::HUGEINT)::VARCHAR" for i in range(4)
    )
    return f"count(*) || ':' || {lanes}"


def cut(name: str, source: str, key: str) -> dict[str, str]:
    """Views that cut the texts of ``source`` (key, text) into segments: one step of the
    walk looks at one sentence, with the open segment as places ``a..e`` in the list."""
    return {
        f"{name}_s": rf"""
            SELECT {key}, s, list_transform(s, lambda x: length(x)) AS n FROM (
              SELECT {key}, list_filter(regexp_split_to_array(
                regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1) || '|\n+'),
                lambda x: length(x) > 0) AS s FROM {source}) WHERE len(s) > 0""",
        f"{name}_w": f"""
            SELECT {key}, n, 1 AS a, 0 AS e, 0::BIGINT AS held, false AS dropping,
              NULL::INT AS ca, NULL::INT AS ce, 0 AS ord FROM {name}_s
            UNION ALL
            SELECT {key}, n,
              CASE WHEN act = 'drop' THEN a + 1 ELSE a END,
              CASE WHEN act = 'add' THEN e + 1 ELSE e END,
              CASE WHEN act = 'drop' THEN held - n[a] - (CASE WHEN e > a THEN 2 ELSE 0 END)
                   WHEN act = 'add' THEN held + n[e + 1] + (CASE WHEN e >= a THEN 2 ELSE 0 END)
                   ELSE held END,
              act IN ('emit', 'drop'),
              CASE WHEN act = 'emit' THEN a END, CASE WHEN act = 'emit' THEN e END,
              CASE WHEN act = 'emit' THEN ord + 1 ELSE ord END
            FROM (SELECT *, CASE
                WHEN e >= len(n) THEN 'end'
                WHEN NOT dropping AND e >= a AND held + n[e + 1] + 2 > 450 THEN 'emit'
                WHEN dropping AND e >= a AND (held > 30 OR held + n[e + 1] + 2 > 450) THEN 'drop'
                ELSE 'add' END AS act FROM {name}_w) WHERE act <> 'end'""",
        name: rf"""
            SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY place) - 1)::INT AS ord, text FROM (
              SELECT {", ".join("c." + k.strip() for k in key.split(","))}, c.place,
                regexp_replace(array_to_string(s[c.a:c.e], {NL} || {NL}), '^\s+|\s+$', '', 'g') AS text
              FROM (SELECT {key}, ca AS a, ce AS e, ord - 1 AS place FROM {name}_w WHERE ca IS NOT NULL
                    UNION ALL SELECT {key}, a, e, ord FROM {name}_w WHERE e = len(n)) c
              JOIN {name}_s USING ({key})) WHERE text <> ''""",
    }


VIEWS: dict[str, str] = {
    "text_tree": """
        SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS folder, text,
          CASE doc_id % 10 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '' END || doc_id || '.txt' AS name FROM documents""",
    "files": """
        SELECT doc_id, '/corpus/' || source || '/' || lang AS folder, name,
          '/corpus/' || source || '/' || lang || '/' || name AS path,
          string_split(name, '.')[-1] AS ext, text
        FROM (SELECT *, CASE WHEN doc_id % 101 = 5 THEN 'Folder_Contents.xlsx' ELSE
            CASE WHEN doc_id % 97 = 0 THEN '~$' ELSE '' END || 'doc_' || doc_id ||
            CASE doc_id % 10 WHEN 4 THEN '.docx' WHEN 5 THEN '.pdf' WHEN 6 THEN '.pptx'
              WHEN 7 THEN '.xlsx' WHEN 8 THEN '.rtf' WHEN 9 THEN '.csv' ELSE '.txt' END END AS name
          FROM documents)""",
    "accepted": r"""
        SELECT * FROM files WHERE regexp_matches(name, '\.(docx|pdf|pptx|xlsx|txt|rtf)$')
          AND name <> 'Folder_Contents.xlsx' AND NOT starts_with(name, '~$')""",
    "joined_lines": f"SELECT doc_id, {join_broken('text')} AS text FROM documents",
    "texts": f"""
        SELECT *, sha256('document:' || hash) AS id FROM (
          SELECT *, sha256(path || '+' || name || '+' || text) AS hash FROM (
            SELECT a.doc_id, a.path, a.name, a.folder, a.ext, CASE
              WHEN a.ext = 'pdf' THEN {drop_repeats('j.text')}
              WHEN a.ext IN ('docx', 'pptx') THEN {drop_repeats('a.text')} ELSE a.text END AS text
            FROM accepted a JOIN joined_lines j USING (doc_id)))""",
    **key_sentences("whole_summaries", "documents", "doc_id", "This document "),
    **key_sentences("doc_summaries", "texts", "doc_id", "This document "),
    "docs": f"""
        SELECT id, name, path AS file_path, folder, ext AS doc_type, hash, doc_id,
          coalesce(s.summary, {quoted(NO_DOCUMENT_SUMMARY)}) AS summary,
          0::BIGINT AS created_ms FROM texts LEFT JOIN doc_summaries s USING (doc_id)""",
    **hashed_vectors("text_vectors", "documents", "doc_id", "text"),
    **hashed_vectors("item_vectors", "benchmark", "item_id", "text"),
    **hashed_vectors("summary_vectors", "docs", "id", "summary"),
    "cut_texts": "SELECT doc_id, text FROM texts WHERE ext <> 'xlsx'",
    **cut("chunks", "cut_texts", "doc_id"),
    **cut("doc_chunks", "documents", "doc_id"),
    **cut("turn_chunks", "conversations", "conv_id, turn"),
    "segments": """
        SELECT sha256('segment:' || t.id || ':' || c.ord) AS id, t.id AS document_id, c.ord, c.text,
          0::BIGINT AS created_ms, doc_id FROM chunks c JOIN texts t USING (doc_id)""",
    **hashed_vectors("segment_vectors", "segments", "id", "text"),
    "queries": """
        SELECT label::BIGINT AS query_id, list(x::FLOAT ORDER BY i) AS vector FROM (
          SELECT label, i, avg(x) AS x FROM (
            SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
          GROUP BY ALL) GROUP BY ALL""",
    "vectors": "SELECT vec_id AS doc_id, embedding AS vector FROM embeddings",
    "tree": """
        SELECT DISTINCT path, string_split(path, '/')[-1] AS name,
          CASE WHEN depth > 1 THEN regexp_replace(path, '/[^/]*$', '') END AS parent, depth FROM (
          SELECT '/corpus' AS path, 1 AS depth FROM accepted
          UNION ALL SELECT regexp_extract(folder, '^/[^/]+/[^/]+'), 2 FROM accepted
          UNION ALL SELECT folder, 3 FROM accepted)""",
    "folders": """
        SELECT sha256('folder:' || hash) AS id, name, path AS file_path, parent, depth, hash, summary, vector,
          0::BIGINT AS created_ms FROM (
          SELECT t.*, sha256(t.path || '+') AS hash, 'Folder' || chr(10) || t.path AS summary, l.vector
          FROM tree t LEFT JOIN (
            SELECT path, arg_min(vector, doc_id) AS vector FROM (
              SELECT unnest(['/corpus', regexp_extract(folder, '^/[^/]+/[^/]+'), folder]) AS path, doc_id, vector
              FROM accepted JOIN vectors USING (doc_id)) GROUP BY path) l ON t.path = l.path)""",
    "labelled": """
        SELECT t.*, l.quality, l.toxic, CASE WHEN l.quality = 0 THEN 'old-' || hash ELSE hash END AS stored_hash
        FROM texts t JOIN labels l USING (doc_id)""",
    "stored": """
        SELECT sha256('document:' || hash) AS id, file_path, hash FROM (
          SELECT path AS file_path, stored_hash AS hash FROM labelled
          UNION ALL SELECT '/corpus/gone/' || name, 'gone-' || hash FROM labelled WHERE toxic = 1)""",
    "stored_segments": """
        SELECT 'turn:' || conv_id || ':' || turn AS id, sha256('document:' || stored_hash) AS document_id,
          turn::INT AS ord, c.text FROM conversations c JOIN labelled l ON l.doc_id = c.conv_id""",
    "changed": "SELECT path, hash FROM texts WHERE hash NOT IN (SELECT hash FROM stored)",
    "stale": "SELECT * FROM stored WHERE file_path IN (SELECT path FROM changed)",
    "scan_status": """
        SELECT path, hash, CASE WHEN hash IN (SELECT hash FROM stored) THEN 'unchanged'
          WHEN path IN (SELECT file_path FROM stored) THEN 'replaced' ELSE 'new' END AS status FROM texts""",
    "blobs": """
        SELECT 'snap-' || event_type || CASE WHEN event_id % 10 = 0 THEN '' ELSE '/part-' || event_id END AS name,
          ts AS last_modified FROM events""",
    "blob_times": """
        SELECT string_split(name, '/')[1] AS snapshot, max(last_modified) AS last_modified FROM blobs
        WHERE contains(name, '/') GROUP BY 1""",
    "doc_texts": f"""
        SELECT folder, string_agg(summary, {SEP} ORDER BY summary) AS text, {mark('summary')} AS mark
        FROM docs GROUP BY folder""",
    **{
        name: view
        for d in (3, 2, 1)
        for name, view in {
            f"level_texts{d}": f"""
        SELECT *, sha256(path || '+' || mark) AS hash FROM (
          SELECT t.*, {'' if d == 3 else "coalesce(k.text, '') || "}coalesce(x.text, '') AS text,
            {"''" if d == 3 else "coalesce(k.mark, '')"} || '|' || coalesce(x.mark, '') AS mark FROM tree t
          LEFT JOIN doc_texts x ON x.folder = t.path
          {'' if d == 3 else f'''LEFT JOIN (SELECT parent, string_agg(summary, {SEP} ORDER BY summary) AS text,
            {mark('summary')} AS mark FROM level{d + 1} GROUP BY parent) k ON k.parent = t.path'''} WHERE depth = {d})""",
            # A provider gets the first words of the text, up to the budget.
            f"level_asked{d}": f"""
        SELECT path, CASE WHEN len({words('text')}) > 5000 THEN {first_words('text', 5000)} ELSE text END AS text FROM level_texts{d}""",
            **key_sentences(f"level_summaries{d}", f"level_asked{d}", "path", "This folder "),
            f"level{d}": f"""
        SELECT *, sha256('folder:' || hash) AS id, coalesce(s.summary, CASE
            WHEN trim(text) = '' THEN {quoted(EMPTY_FOLDER)} ELSE {quoted(NO_FOLDER_SUMMARY)} END) AS summary
        FROM level_texts{d} LEFT JOIN level_summaries{d} s USING (path)""",
        }.items()
    },
    "fresh": "SELECT * FROM level3 UNION ALL SELECT * FROM level2 UNION ALL SELECT * FROM level1",
    "older": """
        SELECT sha256('folder:' || hash) AS id, file_path, hash, summary FROM (
          SELECT path AS file_path, CASE WHEN name = 'de' THEN 'old-' || hash ELSE hash END AS hash, summary
          FROM fresh WHERE name <> 'es'
          UNION ALL SELECT path || '/gone', 'gone-' || hash, summary FROM fresh WHERE depth = 2)""",
    "children": """
        SELECT folder, 1 AS kind_ord, id, summary FROM docs
        UNION ALL SELECT parent, 0, id, summary FROM folders WHERE parent IS NOT NULL""",
    "units": f"""
        SELECT doc_id::VARCHAR AS path, (ord - 1)::INT AS ord, text FROM (
          SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS ord
          FROM (SELECT doc_id, string_split(text, {NL}) AS l FROM documents))""",
    "doc_hits": f"""
        SELECT * FROM (SELECT q.query_id, d.id, {distance('q.vector', 'v.vector')} AS distance,
            row_number() OVER (PARTITION BY query_id ORDER BY {distance('q.vector', 'v.vector')}, d.id)::INT AS rank
          FROM queries q, docs d JOIN vectors v USING (doc_id)) WHERE rank <= 20""",
    "folder_hits": f"""
        SELECT * FROM (SELECT q.query_id, f.id, {distance('q.vector', 'f.vector')} AS distance,
            row_number() OVER (PARTITION BY query_id ORDER BY {distance('q.vector', 'f.vector')}, f.id)::INT AS rank
          FROM queries q, folders f WHERE f.vector IS NOT NULL) WHERE rank <= 20""",
    "doc_distances": f"""
        SELECT q.query_id, v.doc_id, {distance('q.vector', 'v.vector')} AS distance FROM queries q, vectors v""",
    "segment_hits": """
        SELECT * FROM (SELECT query_id, s.id, distance, s.text, s.document_id,
            row_number() OVER (PARTITION BY query_id ORDER BY distance, s.id)::INT AS rank
          FROM doc_distances JOIN segments s USING (doc_id)) WHERE rank <= 20""",
    "contexts": f"""
        SELECT query_id, count(*) AS n, string_agg(text, {NL} || {NL} ORDER BY rank) AS context FROM (
          SELECT *, coalesce(sum(len({words('text')})) OVER (PARTITION BY query_id ORDER BY rank
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM segment_hits)
        WHERE b < 500 GROUP BY 1""",
    "folder_docs": f"""
        SELECT folder, page, {bars('name', 'id')} AS names, {bars('summary', 'id')} AS summaries,
          {bars('file_path', 'id')} AS paths, string_agg(name, '<br>– ' ORDER BY name) AS sorted_names,
          {bars('id', 'id')} AS ids
        FROM (SELECT *, {page('id', 'count(*) OVER (PARTITION BY folder)')} AS page FROM docs) GROUP BY ALL""",
    "folder_subs": f"""
        SELECT parent, page, {bars('name', 'id')} AS names, {bars('file_path', 'id')} AS paths,
          string_agg(name, '<br>– ' ORDER BY name) AS sorted_names
        FROM (SELECT *, {page('id', 'count(*) OVER (PARTITION BY parent)')} AS page FROM folders
              WHERE parent IS NOT NULL) GROUP BY ALL""",
    "folder_pages": """
        SELECT coalesce(d.folder, s.parent) AS file_path, coalesce(d.page, s.page) AS page,
          coalesce(d.names, '') AS documents, coalesce(d.paths, '') AS document_paths,
          coalesce(s.names, '') AS folders, coalesce(d.sorted_names, '') AS flat_documents,
          coalesce(s.sorted_names, '') AS flat_folders
        FROM folder_docs d FULL JOIN folder_subs s ON d.folder = s.parent AND d.page = s.page""",
    "some_summaries": """
        SELECT *, CASE WHEN doc_type = 'xlsx' THEN '' WHEN doc_type <> 'pdf' THEN summary END AS part_summary
        FROM docs""",
}

_HIT_COLUMNS = "h.query_id, h.rank, h.distance, h.id"

BODIES: dict[str, str] = {
    "scan_files": """
        SELECT folder || '/' || name AS file, name, 'txt' AS ext, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes
        FROM text_tree""",
    "read_text_files": r"""
        SELECT folder || '/' || name AS file, length(t)::BIGINT AS n_chars, md5(t) AS text_md5, NULL::VARCHAR AS error FROM (
          SELECT *, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM text_tree)""",
    "render_cells": f"""
        SELECT '/sheets/user_' || user_id || '.xlsx' AS path, event_id // 1000 AS part,
          string_agg(event_type || ' ' || user_id || ' ' || coalesce(nullif(event_type, 'error'), 'None')
            || ' ' || coalesce(props, 'None') || ' ' || {NL}, '' ORDER BY event_id) AS text
        FROM events GROUP BY ALL""",
    "export_folder_contents": """
        SELECT folder, 0 AS kind_ord, name AS file, summary FROM docs
        UNION ALL SELECT parent, 1, name, summary FROM folders WHERE parent IS NOT NULL""",
    "write_snapshot": """
        SELECT 'documents' AS table_name, count(*) AS n_rows FROM docs JOIN vectors USING (doc_id)
        UNION ALL SELECT 'folders', count(*) FROM tree""",
    "latest_snapshot": """
        SELECT snapshot, strftime(last_modified, '%Y-%m-%d %H:%M:%S') AS last_modified FROM blob_times
        ORDER BY blob_times.last_modified DESC, snapshot DESC LIMIT 1""",
    "snapshot_times": """
        SELECT snapshot, strftime(last_modified, '%Y-%m-%d %H:%M:%S') AS last_modified FROM blob_times""",
    "restore_snapshot": """
        SELECT 'documents' AS table_name, id, name, file_path, hash, summary, round(list_sum(vector::DOUBLE[]), 4) AS vector_sum
        FROM docs JOIN vectors USING (doc_id)
        UNION ALL SELECT 'folders', id, name, file_path, hash, summary, round(list_sum(vector::DOUBLE[]), 4) FROM folders""",
    "reconcile_schema": "SELECT doc_id, text, 9 AS n_null FROM documents",
    "reconcile_types": """
        SELECT doc_id, n_chars::BIGINT AS n_chars, lang, NULL::VARCHAR AS source, (doc_id % 7)::BIGINT AS day, NULL::VARCHAR AS by_whom
        FROM documents
        UNION ALL SELECT doc_id + 1000000000000, n_chars::BIGINT, lang, source, (doc_id % 7)::BIGINT, 'x' FROM documents""",
    "insert_object": """
        SELECT id, file_path, hash, NULL AS name FROM stored
        UNION ALL SELECT id, file_path, hash, name FROM docs""",
    "filter_filetypes": r"""
        SELECT path, name FROM files WHERE regexp_matches(name, '\.(docx|pdf|pptx|xlsx|txt|rtf)$')""",
    "filter_avoid_names": "SELECT path, name FROM files WHERE name <> 'Folder_Contents.xlsx'",
    "filter_lock_files": "SELECT path, name FROM files WHERE name NOT LIKE '~$%'",
    "filter_ignored_dirs": """
        SELECT path, folder FROM files WHERE folder NOT LIKE '/corpus/src1%' AND folder NOT LIKE '%/de'""",
    "doc_type": "SELECT path, string_split(path, '.')[-1] AS doc_type FROM files",
    "folder_name": "SELECT path, name FROM tree",
    "lookup_by_id": "SELECT id, file_path, summary FROM docs WHERE id IN (SELECT id FROM stored)",
    "lookup_by_hash": """
        SELECT id, file_path, hash, name, summary FROM docs WHERE hash IN (SELECT hash FROM stored)""",
    "lookup_by_path": """
        SELECT id, file_path, hash, name, summary FROM docs WHERE file_path IN (SELECT file_path FROM stored)""",
    "segments_of_document": """
        SELECT id, document_id FROM segments WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "nonempty_summaries": "SELECT id, part_summary AS summary FROM some_summaries WHERE coalesce(part_summary, '') <> ''",
    "filter_segment_quality": f"SELECT id, text FROM segments WHERE {substantial('text')}",
    "drop_rejected_ids": f"SELECT id, document_id FROM segments WHERE {substantial('text')}",
    "skip_spreadsheet_segments": """
        SELECT doc_type, coalesce(sum(n), 0)::BIGINT AS n_segments FROM docs LEFT JOIN (
          SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) USING (doc_id) GROUP BY doc_type""",
    "list_documents": f"""
        SELECT d.id, name, file_path, hash, summary, created_ms, coalesce(s.segments, '') AS segments
        FROM docs d LEFT JOIN (SELECT doc_id, {bars('text', 'ord')} AS segments FROM chunks
          GROUP BY 1) s USING (doc_id)""",
    "list_folders": """
        SELECT f.id, f.name, f.file_path, f.summary, f.created_ms, coalesce(p.page, '') AS page,
          coalesce(p.documents, '') AS documents, coalesce(p.folders, '') AS folders
        FROM folders f LEFT JOIN folder_pages p USING (file_path)""",
    "list_segments": """
        SELECT s.id, s.text, t.name AS document, s.created_ms FROM segments s JOIN texts t USING (doc_id)""",
    "list_segments_limited": """
        SELECT s.id, s.text, t.name AS document, s.created_ms FROM segments s JOIN texts t USING (doc_id)
        ORDER BY s.id LIMIT 1000""",
    "flatten_documents": """
        SELECT query_id, distance, name, file_path, replace(summary, chr(10), '<br/>') AS summary
        FROM doc_hits JOIN docs USING (id)""",
    "flatten_folders": """
        SELECT query_id, distance, name, file_path, replace(summary, chr(10), '<br/>') AS summary,
          coalesce(page, '') AS page, coalesce(flat_documents, '') AS documents,
          coalesce(flat_folders, '') AS folders
        FROM folder_hits JOIN folders USING (id) LEFT JOIN folder_pages USING (file_path)""",
    "flatten_segments": """
        SELECT query_id, distance, d.name AS document, replace(h.text, chr(10), '<br/>') AS text
        FROM segment_hits h JOIN docs d ON d.id = h.document_id""",
    "join_segment_document": """
        SELECT s.id, document_id, CASE WHEN t.ext = 'pdf' THEN '' ELSE t.name END AS document
        FROM segments s JOIN texts t USING (doc_id)""",
    "join_folder_documents": "SELECT folder, page, names, summaries, paths FROM folder_docs",
    "join_folder_subfolders": """
        SELECT f.file_path, coalesce(s.names, '') AS names, coalesce(s.paths, '') AS paths
        FROM folders f LEFT JOIN folder_subs s ON s.parent = f.file_path""",
    "link_document_segments": f"""
        SELECT d.id, d.name, coalesce(s.segments, '') AS segments FROM docs d LEFT JOIN (
          SELECT doc_id, {bars('id', 'ord')} AS segments FROM segments GROUP BY 1) s USING (doc_id)""",
    "unchanged_documents": """
        SELECT path, hash, k.id FROM texts JOIN (
          SELECT hash, min(id) AS id FROM stored GROUP BY 1) k USING (hash)""",
    "changed_or_new_documents": "SELECT path, hash FROM changed",
    "stale_documents": "SELECT id, file_path, hash FROM stale",
    "cascade_delete": """
        SELECT s.id, file_path, coalesce(n, 0)::BIGINT AS n_segments FROM stored s LEFT JOIN (
          SELECT document_id, count(*) AS n FROM stored_segments GROUP BY 1) k ON k.document_id = s.id
        WHERE s.id NOT IN (SELECT id FROM stale)""",
    "cascade_delete_segments": """
        SELECT id, document_id, ord, text FROM stored_segments WHERE document_id NOT IN (SELECT id FROM stale)""",
    "stale_folders": """
        SELECT o.id, o.file_path, o.hash FROM older o JOIN fresh f ON f.path = o.file_path AND f.hash <> o.hash""",
    "query_corpus_pairs": """
        SELECT * FROM (SELECT query_id, doc_id::VARCHAR AS id, distance,
          row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id::VARCHAR)::INT AS rank
          FROM doc_distances) WHERE rank <= 15""",
    "count_items": """
        SELECT (SELECT count(*) FROM accepted) AS n_files,
          (SELECT count(*) FROM tree WHERE depth > 1) AS n_folders""",
    "folder_sum_text": f"""
        SELECT folder, kind_ord, (rn - 1) // 1000 AS part,
          string_agg(summary || CASE WHEN rn < n THEN {SEP} ELSE '' END, '' ORDER BY rn) AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY folder, kind_ord ORDER BY summary, id) AS rn,
          count(*) OVER (PARTITION BY folder, kind_ord) AS n FROM children) GROUP BY ALL""",
    "folder_children": """
        SELECT folder AS path, count(*) FILTER (kind_ord = 1) AS n_documents,
          count(*) FILTER (kind_ord = 0) AS n_folders FROM children GROUP BY 1""",
    "collect_doc_ids": "SELECT folder, page, ids FROM folder_docs",
    "folder_rollup": "SELECT id, name, path AS file_path, parent, depth, hash, summary FROM fresh",
    "index_counts": "SELECT status, count(*) AS n FROM scan_status GROUP BY 1",
    "classify_scan": "SELECT path, hash, status FROM scan_status",
    "drop_repeat_lines": """
        SELECT path, ord, text FROM (SELECT *, lag(text) OVER (PARTITION BY path ORDER BY ord) AS b FROM units)
        WHERE ord = 0 OR text IS DISTINCT FROM b""",
    "join_broken_lines": "SELECT doc_id, text FROM joined_lines",
    "repair_extracted_text": f"SELECT doc_id, {drop_repeats('text')} AS text FROM joined_lines",
    "extracted_texts": "SELECT path, text FROM texts",
    "chunk_text": "SELECT doc_id, ord, text AS chunk FROM doc_chunks",
    "document_segments": "SELECT id, document_id, ord, text FROM segments",
    "chunk_conversations": "SELECT conv_id, turn, ord, text AS chunk FROM turn_chunks",
    "topk_per_query": """
        SELECT * FROM (SELECT query_id, doc_id::VARCHAR AS id, distance,
          row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id::VARCHAR)::INT AS rank
          FROM doc_distances) WHERE rank <= 10""",
    "search_docs": f"""
        SELECT {_HIT_COLUMNS}, d.name, d.file_path, d.summary, d.created_ms FROM doc_hits h JOIN docs d USING (id)""",
    "search_folders": f"""
        SELECT {_HIT_COLUMNS}, f.name, f.file_path, f.summary, coalesce(p.page, '') AS page,
          coalesce(p.documents, '') AS documents, coalesce(p.document_paths, '') AS document_paths,
          coalesce(p.folders, '') AS folders
        FROM folder_hits h JOIN folders f USING (id) LEFT JOIN folder_pages p USING (file_path)""",
    "search_segments": f"""
        SELECT {_HIT_COLUMNS}, h.text, d.name AS document, 0::BIGINT AS created_ms
        FROM segment_hits h JOIN docs d ON d.id = h.document_id""",
    "search_context": f"""
        SELECT q.query_id, coalesce(n, 0)::INT AS n_segments, context FROM queries q LEFT JOIN contexts USING (query_id)""",
    "search_answers": f"""
        SELECT query_id, n::INT AS n_segments, 'A prompt of ' || length({quoted(ANSWER_INSTRUCTIONS)} || {NL} || {NL}
          || 'Question: What is topic ' || query_id || '?' || {NL} || {NL}
          || context) AS answer FROM contexts
        UNION ALL SELECT -1, 0, NULL""",
    "embed": "SELECT doc_id, vector FROM text_vectors",
    "search_texts": f"""
        SELECT {_HIT_COLUMNS}, d.name, d.file_path, d.summary FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM (
            SELECT q.item_id AS query_id, v.id, {distance('q.vector', 'v.vector')} AS distance FROM item_vectors q, summary_vectors v)) h
        JOIN docs d USING (id) WHERE rank <= 20""",
    "search_cells": f"""
        SELECT count(DISTINCT query_id) AS n_queries, round(sum(distance), 3) AS exact_distances, true AS recall_reached
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance) AS rank FROM (
            SELECT s.doc_id AS query_id, {distance('q.vector', 'v.vector')} AS distance
            FROM segments s JOIN segment_vectors q USING (id), segment_vectors v WHERE s.doc_id % 50 = 0 AND s.ord = 0))
        WHERE rank <= 10""",
    "limit_rows": "SELECT path, ord, text FROM units ORDER BY path, ord LIMIT 5000",
    "sort_summaries": f"""
        SELECT folder, (rn - 1) // 1000 AS part,
          string_agg(summary || CASE WHEN rn < n THEN {SEP} ELSE '' END, '' ORDER BY rn) AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY summary, id) AS rn,
          count(*) OVER (PARTITION BY folder) AS n FROM docs) GROUP BY ALL""",
    "upsert_documents": """
        SELECT id, file_path, hash FROM stored WHERE file_path NOT IN (SELECT path FROM changed)
        UNION ALL SELECT sha256('document:' || hash), path, hash FROM changed""",
    "upsert_documents_pruned": """
        SELECT id, file_path, hash FROM stored WHERE file_path NOT IN (SELECT path FROM changed)
          AND file_path IN (SELECT path FROM texts)
        UNION ALL SELECT sha256('document:' || hash), path, hash FROM changed""",
    "upsert_folders": """
        SELECT id, path AS file_path, hash, summary FROM fresh
        UNION ALL SELECT id, file_path, hash, summary FROM older WHERE file_path NOT IN (SELECT path FROM fresh)""",
    "document_hash": "SELECT path, sha256(path || '+' || name || '+' || text) AS hash FROM accepted",
    "folder_hash": "SELECT folder, sha256(folder || '+' || mark) AS hash FROM doc_texts",
    "truncate_tokens": f"""
        SELECT doc_id, CASE WHEN len(w) > 5000 THEN array_to_string(w[1:5000], ' ') ELSE text END AS text,
          len(w) > 5000 AS truncated FROM (SELECT doc_id, text, {words('text')} AS w FROM documents)""",
    "build_prompt": f"""
        SELECT path, replace({quoted(DOCUMENT_INSTRUCTIONS)}, '%s', ext) || {NL} || {NL}
          || CASE WHEN len(w) > 400 THEN {quoted(EXCERPT_NOTE)} || {NL} || {NL} || array_to_string(w[1:400], ' ') ELSE text END AS prompt
        FROM (SELECT path, ext, text, {words('text')} AS w FROM texts)""",
    "build_folder_prompt": f"""
        SELECT folder, {quoted(FOLDER_INSTRUCTIONS)} || {NL} || {NL} || CASE
            WHEN len(w) > 5000 THEN array_to_string(w[1:5000], ' ') ELSE text END AS prompt
        FROM (SELECT folder, text, {words('text')} AS w FROM doc_texts)""",
    "summary_or_default": f"""
        SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN text ELSE {quoted(NO_DOCUMENT_SUMMARY)} END
          AS summary FROM conversations""",
    "embedding_input": "SELECT id, coalesce(nullif(part_summary, ''), name) AS text FROM some_summaries",
    "json_flag": """
        SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN true ELSE value > 10 END AS meaningful
        FROM events""",
    "json_number": """
        SELECT event_id, CASE json_extract_string(props, '$.k') WHEN '0' THEN false ELSE true END AS flag FROM events""",
    "snapshot_id": """
        SELECT page_id, regexp_replace(replace(url || '_10_391_92_6_2024-05-06-' || page_id, ' ', '_'),
          '[^a-z0-9_-]', '', 'g') AS id FROM pages""",
    "split_lines": "SELECT path, ord, text FROM units",
    "break_to_html": "SELECT doc_id, replace(text, chr(10), '<br/>') AS html FROM documents",
    "cosine_distance": f"""
        SELECT vec_id, {distance('e.embedding', 'q.vector')} AS distance
        FROM embeddings e JOIN queries q ON q.query_id = e.label""",
    "summarise": f"""
        SELECT d.doc_id, coalesce(s.summary, 'no summary') AS summary FROM documents d LEFT JOIN whole_summaries s USING (doc_id)""",
    "fallback_chain": f"""
        SELECT conv_id, turn, CASE WHEN length(text) <= 120 THEN text
          WHEN NOT contains(text, {NL}) THEN coalesce({lead('text', 'Lines: ', 5)}, 'no answer')
          ELSE 'no answer' END AS answer FROM conversations""",
    "classify_segments": "SELECT id, regexp_matches(text, '[.!?]') AS meaningful FROM segments",
    "run_index_models": """
        SELECT id, file_path, 'Of ' || length(t.text) || ' characters' AS summary,
          length('Of ' || length(t.text) || ' characters')::DOUBLE AS v0,
          len(regexp_extract_all('Of ' || length(t.text) || ' characters', 'e'))::DOUBLE AS v1,
          coalesce(n, 0)::BIGINT AS n_segments, coalesce(chars, 0)::DOUBLE AS n_chars
        FROM (SELECT doc_id, id, path AS file_path, text FROM texts) t LEFT JOIN (
          SELECT doc_id, count(*) AS n, sum(length(text)) AS chars FROM chunks WHERE length(text) % 3 <> 0
          GROUP BY 1) USING (doc_id)""",
    "refresh_index": """
        SELECT id, name, file_path, hash, summary, coalesce(n, 0)::BIGINT AS n_segments FROM docs LEFT JOIN (
          SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) USING (doc_id)""",
    "refresh_snapshot": """
        SELECT id, name, file_path, hash, summary, coalesce(n, 0)::BIGINT AS n_segments FROM docs LEFT JOIN (
          SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) USING (doc_id)
        UNION ALL SELECT id, name, path, hash, summary, NULL FROM fresh""",
    "run_index": "SELECT id, name, file_path, folder, doc_type, hash, summary FROM docs",
}


def _needs(sql: str) -> list[str]:
    """The views a statement uses, directly or not, in the order they are defined."""
    import re

    found: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\b(?:FROM|JOIN|,)\s+(\w+)", text)) & VIEWS.keys() - found:
            found.add(name)
            visit(VIEWS[name])

    visit(sql)
    return [name for name in VIEWS if name in found]


def _sql(body: str) -> str:
    views = _needs(body)
    if not views:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in views)
    return f"WITH RECURSIVE {ctes}\n{body.strip()}"


def statements() -> dict[str, str]:
    return {name: _sql(body) for name, body in BODIES.items()}
