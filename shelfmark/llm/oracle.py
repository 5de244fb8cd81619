r"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from shelfmark.llm import quality_rules as qr
from shelfmark.llm.license_rules import BASE, all_rules, spaced
from shelfmark.llm.license_scan import CLASS_SCORES
from shelfmark.llm.mixing import SHARE, WEIGHTS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


EXACT_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


def mix_ctes(docs: str) -> str:
    """CTEs up to ``taken``: (doc_id, size, source_size, target, copies)."""
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return rf"""
mix_sized AS (
  SELECT *, coalesce('=' || source, '~') AS mix_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS mix_size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS mix_hash
  FROM {docs}),
mix_source AS (SELECT mix_key, sum(mix_size)::BIGINT AS source_size FROM mix_sized GROUP BY mix_key),
mix_ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY mix_key) - 1) % {len(WEIGHTS)} {weight} END::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap FROM mix_source),
mix_ordered AS (
  SELECT *, cap / weight AS ratio,
         sum(cap) OVER w AS capped, sum(weight) OVER () - sum(weight) OVER w AS free,
         lead(cap / weight) OVER (ORDER BY cap / weight, mix_key) AS next_ratio
  FROM mix_ranked WINDOW w AS (ORDER BY cap / weight, mix_key ROWS UNBOUNDED PRECEDING)),
mix_levels AS (
  SELECT (sum(source_size) * {SHARE[0]} / {SHARE[1]})::DOUBLE / sum(weight) AS level, 0 AS ratio, min(ratio) AS next_ratio FROM mix_ordered
  UNION ALL
  SELECT ((SELECT sum(source_size) * {SHARE[0]} / {SHARE[1]} FROM mix_ordered)::DOUBLE - capped) / free, ratio, next_ratio
  FROM mix_ordered WHERE free > 0),
mix_goals AS (
  SELECT mix_key, source_size, least(cap, weight * (SELECT min(level) FROM mix_levels WHERE ratio <= level AND next_ratio > level)) AS target
  FROM mix_ordered),
mix_wants AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM mix_goals),
mix_groups AS (
  SELECT mix_key, mix_hash, sum(mix_size) AS size FROM mix_sized GROUP BY ALL),
mix_runs AS (
  SELECT *, sum(size) OVER (PARTITION BY mix_key ORDER BY mix_hash ROWS UNBOUNDED PRECEDING) AS upto FROM mix_groups),
mix_more AS (
  SELECT r.mix_key, r.mix_hash,
         g.target - g.passes * g.source_size > 0 AND 2 * r.upto - r.size <= 2 * (g.target - g.passes * g.source_size) AS more
  FROM mix_runs r JOIN mix_wants g USING (mix_key)),
mix_taken AS (
  SELECT s.* EXCLUDE (mix_key, mix_hash), g.source_size, g.target, g.passes + m.more::BIGINT AS copies
  FROM mix_sized s JOIN mix_wants g USING (mix_key) JOIN mix_more m USING (mix_key, mix_hash))"""


MIX_SOURCES = f"""
WITH d AS (SELECT doc_id, text, source FROM documents), {mix_ctes('d')}
SELECT doc_id, mix_size AS size, source_size, target, mix_size * copies AS taken FROM mix_taken
"""


def license_scan() -> str:
    rules = ", ".join(
        f"({i}, {r.kind}, {quoted(r.label)}, {quoted(r.keyword)}, {quoted(spaced(r.pattern))})"
        for i, r in enumerate(all_rules())
    )
    scores = " ".join(f"WHEN {k} THEN {s}::DOUBLE" for k, s in enumerate(CLASS_SCORES))
    listed = "coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER ({}), '')"
    return rf"""
WITH rules(rule, kind, label, keyword, pattern) AS (VALUES {rules}),
words AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS w
  FROM documents),
tried AS (
  SELECT row_no, rule, kind, label,
         string_split(regexp_replace(' ' || replace(w, ' ', '  ') || ' ', pattern, chr(1) || '\0' || chr(2), 'g'), chr(1)) AS pieces
  FROM words JOIN rules ON contains(w, keyword)),
pieces AS (
  SELECT row_no, rule, kind, label, unnest(range(len(pieces))) AS place, unnest(pieces) AS piece FROM tried WHERE len(pieces) > 1),
placed AS (
  SELECT *, (sum(len(piece) - len(replace(piece, ' ', ''))) OVER (
           PARTITION BY row_no, rule ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 2)::BIGINT AS start_word,
         split_part(piece, chr(2), 1) AS found
  FROM pieces),
hits AS (
  SELECT *, start_word + (len(found) - len(replace(found, ' ', ''))) // 2 AS end_word FROM placed WHERE place > 0),
judged AS (
  SELECT h.*, EXISTS (
    SELECT 1 FROM hits e WHERE e.row_no = h.row_no AND e.kind <= h.kind AND e.start_word <= h.start_word AND e.end_word >= h.end_word
      AND ((e.start_word, -e.end_word, e.kind, e.rule) < (h.start_word, -h.end_word, h.kind, h.rule))) AS suppressed
  FROM hits h),
found AS (
  SELECT row_no, count(*) FILTER (kind = {BASE}) AS n_base, min(start_word) FILTER (kind = {BASE}) AS first_word,
         max(start_word) FILTER (kind = {BASE}) AS last_word, {listed.format(f'kind = {BASE}')} AS base_labels,
         {listed.format(f'kind = {BASE} OR NOT suppressed')} AS labels,
         coalesce(max(CASE kind {scores} END) FILTER (NOT suppressed), 0::DOUBLE) AS score,
         count(*) FILTER (NOT suppressed) AS n_found
  FROM judged GROUP BY row_no)
SELECT doc_id, CASE WHEN w = '' THEN 0 ELSE len(w) - len(replace(w, ' ', '')) + 1 END AS n_words,
       coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0::DOUBLE) AS score, coalesce(n_found, 0) AS n_found
FROM words LEFT JOIN found USING (row_no)
"""


# The rendering's length follows from its rules: control strings of a template of three marks
# of eight characters a turn, and two more characters for each escape.
CHAT_FORMAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, role || text AS both_, role || chr(10) || text || chr(10) AS said,
         CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM rows),
escaped AS (
  SELECT *, 24 + len(both_) + len(both_) - len(replace(both_, '\', ''))
         + 2 * len(regexp_extract_all(role, '<\|(?:turn|says|done|endoftext|im_start|im_end)\|>|</?s>|\[/?INST\]'))
         + 2 * len(regexp_extract_all(text, '<\|(?:turn|says|done|endoftext|im_start|im_end)\|>|</?s>|\[/?INST\]')) AS chars
  FROM sized)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(said, '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       len(string_agg(loss, '' ORDER BY turn NULLS LAST, role, text)) AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn NULLS LAST, role, text)) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


# All pairs by shared shingles, and the closure of their links: for small tables only.
JACCARD_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


def quality_rules(rounds: int = qr.ROUNDS) -> str:
    """Counts and votes, then as many steps of expectation-maximisation as the query takes."""
    rules = range(len(qr.RULES))
    counted = ", ".join(f"len(regexp_extract_all(t, {quoted(p)})) AS {c}" for c, p in qr.PATTERNS.items())
    common = ", ".join(map(quoted, qr.FUNCTION_WORDS))
    votes = ", ".join(
        f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v{i}" for i, r in enumerate(qr.RULES)
    )
    names = ", ".join(f"v{i}" for i in rules)

    def posterior() -> str:
        terms = [f"CASE v{i} WHEN 1 THEN ln(g{i} / (1 - b{i})) WHEN -1 THEN ln((1 - g{i}) / b{i}) ELSE 0 END" for i in rules]
        return f"1 / (1 + exp(-(ln(pi / (1 - pi)) + {' + '.join(terms)})))"

    def rate(right: str, voted: str, begin: float, weight: float) -> str:
        return f"(coalesce(sum({right}), 0) + {weight} * sum(n) * {begin}) / (coalesce(sum({voted}), 0) + {weight} * sum(n))"

    step = ", ".join(
        [f"{rate('n * p', 'n', qr.START_GOOD, qr.WEIGHT_ON_GOOD)} AS pi"]
        + [f"{rate(f'CASE WHEN v{i} = 1 THEN n * p END', f'CASE WHEN v{i} <> 0 THEN n * p END', qr.START_RIGHT_ON_GOOD, qr.WEIGHT_ON_GOOD)} AS g{i}" for i in rules]
        + [f"{rate(f'CASE WHEN v{i} = -1 THEN n * (1 - p) END', f'CASE WHEN v{i} <> 0 THEN n * (1 - p) END', qr.START_RIGHT_ON_BAD, qr.WEIGHT_ON_BAD)} AS b{i}" for i in rules]
    )
    begin = ", ".join(
        [f"{qr.START_GOOD}::DOUBLE AS pi"] + [f"{qr.START_RIGHT_ON_GOOD}::DOUBLE AS g{i}, {qr.START_RIGHT_ON_BAD}::DOUBLE AS b{i}" for i in rules]
    )
    steps = ",\n".join(
        f"m{k} AS MATERIALIZED (SELECT {step} FROM (SELECT *, {posterior()} AS p FROM patterns, m{k - 1}))" for k in range(1, rounds + 1)
    )
    return rf"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
places AS (
  SELECT row_no, unnest(range(len(w) - {qr.WINDOW - 1})) AS i,
         unnest(list_transform(range(len(w) - {qr.WINDOW - 1}), lambda i: array_to_string(w[i + 1:i + {qr.WINDOW}], ' '))) AS said FROM texts WHERE len(w) >= {qr.WINDOW}),
again AS (SELECT row_no, i FROM (SELECT *, count(*) OVER (PARTITION BY row_no, said) AS c FROM places) WHERE c > 1),
repeats AS (SELECT row_no, count(DISTINCT i + k) AS n FROM again, range({qr.WINDOW}) ks(k) GROUP BY row_no),
counts AS MATERIALIZED (
  SELECT row_no, doc_id, len(w) AS n_words, coalesce(len(array_to_string(w, '')), 0) AS word_chars, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
         len(list_distinct(w)) AS n_distinct_words, len(list_intersect(w, [{common}])) AS n_function_words, {counted}
  FROM texts LEFT JOIN repeats USING (row_no)),
voted AS MATERIALIZED (SELECT *, {votes} FROM counts),
patterns AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS n FROM voted GROUP BY {names}),
m0 AS (SELECT {begin}),
{steps},
judged AS (
  SELECT *, n_words < {qr.LEAST_WORDS} OR 100 * n_repeat_words > {qr.REPEAT_PERCENT} * n_words AS base_failed, {posterior()} AS posterior
  FROM voted, m{rounds})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept, posterior
FROM judged
"""


FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT for i in range(4)] AS h FROM d),
formed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s
  FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


def statements() -> dict[str, str]:
    return {
        "op3_mix_sources": MIX_SOURCES,
        "op6_license_scan": license_scan(),
        "op7_exact_dedup": EXACT_DEDUP,
        "op8_chat_format": CHAT_FORMAT,
        "op10_jaccard_join": JACCARD_JOIN,
        "op11_fill_in_middle": FILL_IN_MIDDLE,
        "op12_quality_rules": quality_rules(),
    }
