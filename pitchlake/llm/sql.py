"""DuckDB SQL for those queries of this subpackage that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op7_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

_ESCAPED = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '>', '&gt;')"

ORACLES["op6_chat_format"] = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS was, length({_ESCAPED.format('text')})
   + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + length({_ESCAPED.format('role')}) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars,
 bool_and(CASE role WHEN 'system' THEN was IS NULL WHEN 'user' THEN was IS NULL OR was IN ('system', 'assistant') WHEN 'assistant' THEN coalesce(was = 'user', false) ELSE false END) AS valid
FROM t GROUP BY conv_id
"""

_WHITE = "concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))"

ORACLES["op11_line_dedup"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
 l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM d),
 k AS (SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
 m AS (SELECT k.*, g.top IS NULL OR k.doc_id = g.top AS kept FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (kept), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
