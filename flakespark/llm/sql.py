"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from .rules import LEAST_WORDS, LINE_DOCS, LINE_PERCENT, LOST_PERCENT, MOST_REPEATED_PERCENT, SYMBOLS
from .urlrules import RULES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"
_GAP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM rows WHERE speaker <> 'system'),
seen AS (
  SELECT r.conv_id, p.perspective, r.turn, r.speaker, r.text, r.speaker = p.perspective AS is_target,
    CASE WHEN r.speaker = p.perspective THEN 'assistant' WHEN r.speaker = 'system' THEN 'system'
      ELSE 'user name=' || replace(replace(replace(replace(replace(replace(replace(r.speaker, '%', '%25'), ' ', '%20'), chr(9), '%09'), chr(10), '%0A'), chr(13), '%0D'), '<\', '<\\'), '<|', '<\|') END AS who,
    replace(replace(r.text, '<\', '<\\'), '<|', '<\|') || '<|im_end|>' || chr(10) AS body
  FROM rows r JOIN people p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
shown AS (SELECT *, '<|im_start|>' || who || chr(10) AS head FROM seen),
placed AS (
  SELECT *, (sum(length(head || body)) OVER own - length(head || body))::BIGINT AS start, row_number() OVER own AS k
  FROM shown WINDOW own AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, md5(speaker || chr(10) || text), speaker, text ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, start // 1048576 AS part, min(start) OVER (PARTITION BY conv_id, perspective, start // 1048576) AS begin FROM placed)
SELECT conv_id, perspective, part::BIGINT AS part, min(start) AS start, count(*)::BIGINT AS n_turns, string_agg(head || body, '' ORDER BY k) AS dialogue,
  coalesce(string_agg((start - begin + length(head))::BIGINT || '-' || (start - begin + length(head || body))::BIGINT, ',' ORDER BY k) FILTER (is_target), '') AS targets,
  sum(length(head || body))::BIGINT AS n_chars
FROM cut GROUP BY conv_id, perspective, part
"""

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, host, text, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
grams AS (SELECT rid, i, ws[i:i+4] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT rid, g FROM grams GROUP BY rid, g HAVING count(*) > 1),
covered AS (SELECT DISTINCT rid, i + k AS p FROM grams SEMI JOIN twice USING (rid, g), (SELECT unnest(range(5)) AS k)),
rep AS (SELECT rid, count(*) AS n FROM covered GROUP BY rid),
raw AS (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT rid, host, text, line, len(regexp_extract_all(line, '{_WORD}')) AS words,
    translate(array_to_string(regexp_extract_all(line, '{_WORD}'), ' '), '{_UP}', '{_LOW}') AS norm
  FROM raw WHERE trim(line, {_GAP}) <> ''),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
documents_of AS (SELECT DISTINCT host, doc_id, text FROM w WHERE len(ws) > 0),
hosts AS (SELECT host, count(*) AS documents FROM documents_of GROUP BY host),
held AS (SELECT DISTINCT host, doc_id, text, norm FROM lines JOIN d USING (rid, host, text)),
gone AS (
  SELECT host, norm FROM held GROUP BY host, norm
  HAVING count(*) > {LINE_DOCS} AND 100 * count(*) > {LINE_PERCENT} * (SELECT h.documents FROM hosts h WHERE h.host = held.host)),
lost AS (SELECT rid, count(*) AS removed, sum(words) AS n FROM lines WHERE (host, norm) IN (SELECT host, norm FROM gone) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(translate(text, {_GAP}, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS n_removed_lines, coalesce(lost.n, 0)::BIGINT AS n_lost_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words) AND 100 * n_lost_words <= {LOST_PERCENT} * n_words AS kept
FROM m
"""

URLS = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN fit USING (page_id)
"""

#: Copies are joined by their sets; all other links through the shingles that two sets share.
JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws] ELSE list_distinct([ws[i:i+4] FOR i IN range(1, len(ws) - 3)]) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS common FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o WHERE 100 * common >= 75 * (total - common)),
reach AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a),
k AS (SELECT a AS doc_id, count(*) AS links FROM e GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(low, doc_id)::BIGINT AS component_id, coalesce(links, 0)::BIGINT AS n_links
FROM s LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

ORACLES = {"op3_chat_rotation": CHAT, "op5_quality_rules": QUALITY, "op6_url_filter": URLS, "op10_jaccard_join": JACCARD}
