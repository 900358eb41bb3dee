"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH item AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS w FROM benchmark),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sized AS (SELECT item_id, w, least(13, len(w)) AS k FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
        FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
spot AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
         FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
               FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
found AS (SELECT doc_id, spot.k, i, item_id FROM spot JOIN win ON spot.s = win.s AND spot.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s
          FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(names.n, 0)::BIGINT AS n_items,
       sha256(coalesce(names.s, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
"""

#: Control strings: first character and the rest as a pattern.
_CONTROLS = (("<", r"\|"), ("<", "s>"), ("<", "/s>"), ("\\[", r"INST\]"), ("\\[", r"/INST\]"), ("<", "<SYS>>"), ("<", "</SYS>>"))
_ESCAPED = "said"
for _first, _rest in _CONTROLS:
    _ESCAPED = f"regexp_replace({_ESCAPED}, '({_first})(\\\\*{_rest})', '\\1\\\\\\2', 'g')"

OP2 = rf"""
WITH every AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
               UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn, role, said)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(said) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(said, '' ORDER BY turn, role, said) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(8 + length(role) + 9 + length({_ESCAPED}) + 8)::BIGINT AS formatted_chars
FROM every GROUP BY conv_id
"""

ORACLES = {"op1_decontaminate": OP1, "op2_chat_format": OP2}
