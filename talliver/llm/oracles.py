"""DuckDB SQL that states the results of operators 1, 2, 3, 6 and 10 plainly, without their methods."""

from __future__ import annotations

from talliver.llm.chat_format import CLOSE, MIDDLE, OPEN
from talliver.llm.decontaminate import SLOP
from talliver.llm.secret_scan import ALL_RULES

_SPACED = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ROWS = "d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)"


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NGRAM_JOIN = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT text, count(*) AS weight, min(doc_id) AS low FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY text) AS node, text, weight, low, regexp_extract_all({_LOWER}, {_SPACED}) AS ws FROM t),
s AS MATERIALIZED (SELECT DISTINCT node, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1 : i + 5], ' ')) END) AS shingle FROM w),
n AS MATERIALIZED (SELECT node, count(*) AS n FROM s GROUP BY node),
o AS (SELECT a.node AS a, b.node AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.node <> b.node GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (SELECT node AS a, node AS b FROM n UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
comp AS (SELECT a AS node, min(low) AS component_id FROM reach JOIN w ON w.node = reach.b GROUP BY 1),
deg AS (SELECT a AS node, sum(weight) AS links FROM l JOIN w ON w.node = l.b GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
 CAST(CASE WHEN n.n IS NULL THEN 0 ELSE w.weight - 1 + coalesce(links, 0) END AS BIGINT) AS n_links
FROM documents LEFT JOIN w ON w.text = documents.text LEFT JOIN n USING (node) LEFT JOIN comp USING (node) LEFT JOIN deg USING (node)"""


def _secret_matches() -> str:
    """(rid, kind, name, base, start, end): lengths of what lies between the matches and of the matches give their places."""
    parts = []
    for kind, rule in enumerate(ALL_RULES):
        p = _literal(rule.pattern)
        parts.append(f"""SELECT rid, {kind} AS kind, '{rule.name}' AS name, {rule.base} AS base, place AS s, place + length(m[k]) AS e FROM (
 SELECT rid, m, g, k, CAST(list_sum(list_transform(gaps[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0) AS BIGINT) AS place
 FROM (SELECT rid, m, g, gaps, unnest(range(1, len(m) + 1)) AS k FROM (SELECT rid, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {rule.group}) AS g, regexp_split_to_array(text, {p}) AS gaps FROM d))) WHERE length(g[k]) >= {rule.least}""")
    return "\nUNION ALL ".join(parts)


_SPAN = "string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind)"
SECRETS = f"""WITH {_ROWS}, f AS ({_secret_matches()}),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {_SPAN} FILTER (base) AS base, {_SPAN} AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""

SUBSTRINGS = f"""WITH {_ROWS}, w AS MATERIALIZED (SELECT rid, doc_id, coalesce(regexp_extract_all(text, {_SPACED}), []) AS ws FROM d),
v AS MATERIALIZED (SELECT rid, doc_id, i, array_to_string(ws[i + 1 : i + 13], ' ') AS words FROM (SELECT rid, doc_id, ws, unnest(range(len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13 AND doc_id IS NOT NULL)),
low AS (SELECT words, min(doc_id) AS first FROM v GROUP BY words),
c AS (SELECT rid, list(i ORDER BY i) AS starts FROM v JOIN low USING (words) WHERE first < doc_id GROUP BY rid),
x AS (SELECT rid, list_distinct(flatten(list_transform(starts, lambda i: range(i + 1, i + 14)))) AS gone FROM c),
k AS (SELECT rid, count(*) AS kept, string_agg(word, ' ' ORDER BY p) AS text FROM (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w)
  ANTI JOIN (SELECT rid, unnest(gone) AS p FROM x) USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN k USING (rid)"""

_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
# A near window is looked for around the places of that of its words which the documents hold least.
DECONTAMINATION = f"""WITH {_ROWS}, w AS MATERIALIZED (SELECT rid, doc_id, coalesce(regexp_extract_all({_LOWER}, {_PLAIN}), []) AS ws FROM d),
iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, {_PLAIN}) AS ws FROM benchmark WHERE text IS NOT NULL),
win AS MATERIALIZED (SELECT DISTINCT item, ws[i + 1 : i + 13] AS words FROM (SELECT item, ws, unnest(range(greatest(len(ws) - 12, 1))) AS i FROM iw WHERE len(ws) > 0)),
p AS MATERIALIZED (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
sizes AS (SELECT DISTINCT len(words) AS n FROM win),
e AS MATERIALIZED (SELECT DISTINCT rid, item, p, len(words) AS n FROM (SELECT rid, p, ws[p : p + n - 1] AS words FROM p JOIN w USING (rid) CROSS JOIN sizes WHERE p + n - 1 <= len(ws) AND word IN (SELECT words[1] FROM win)) JOIN win USING (words)),
h AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS place FROM (SELECT DISTINCT rid, p, n FROM e)) GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM e GROUP BY rid),
sets AS MATERIALIZED (SELECT DISTINCT item, list_sort(list_distinct(words)) AS words FROM win),
often AS (SELECT word, count(*) AS c FROM p GROUP BY word),
rare AS (SELECT words, arg_min(u.word, coalesce(c, 0)) AS word, bool_and(c IS NOT NULL) AS possible FROM (SELECT words, unnest(words) AS word FROM (SELECT DISTINCT words FROM sets)) u LEFT JOIN often USING (word) GROUP BY words),
cand AS (SELECT DISTINCT rid, words, p FROM rare JOIN p USING (word) WHERE possible),
close AS (SELECT DISTINCT rid, words FROM cand JOIN w USING (rid)
  WHERE len(list_filter(range(greatest(p - {12 + SLOP}, 1), p + 1), lambda b: list_has_all(ws[b : b + {12 + SLOP}], words))) > 0),
n AS (SELECT rid, count(DISTINCT item) AS n_near FROM close JOIN sets USING (words) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(ws) AS contaminated, coalesce(n_near, 0) AS n_near
FROM w LEFT JOIN h USING (rid) LEFT JOIN i USING (rid) LEFT JOIN n USING (rid)"""


def _side(name: str) -> str:
    """One row per pair: the turns after the common ones, rendered, and the spans of the assistant's among them."""
    return f"""(SELECT pair_id, string_agg(body, '' ORDER BY k) AS {name}, string_agg((s + head) || ':' || (s + size), ',' ORDER BY k) FILTER (role = 'assistant') AS {name}_mask
 FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY pair_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM {name}_turns JOIN n USING (pair_id) WHERE k > n_prompt_turns) GROUP BY pair_id)"""


def _turns(source: str) -> str:
    head = f"{_literal(OPEN)} || role || {_literal(MIDDLE)}"
    return f"""(SELECT *, length(head_text) AS head, head_text || text || {_literal(CLOSE)} AS body, length(head_text || text || {_literal(CLOSE)}) AS size FROM (
 SELECT *, {head} AS head_text, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role, text) AS k FROM (
  SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {source} WHERE conv_id IS NOT NULL)))"""


PREFERENCES = f"""WITH c AS MATERIALIZED (SELECT conv_id, turn, role, text FROM conversations),
a AS (SELECT conv_id, max(turn) AS last, max({{'turn': turn, 'text': text}}).text AS answer FROM c WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT c.conv_id, turn, role, CASE WHEN coalesce(turn = own.last AND role = 'assistant', FALSE) THEN other.answer ELSE text END AS text
 FROM c LEFT JOIN a own ON own.conv_id = c.conv_id LEFT JOIN a other ON other.conv_id = c.conv_id + 1 AND own.conv_id IS NOT NULL
 WHERE NOT coalesce(turn = own.last AND role = 'assistant', FALSE) OR other.conv_id IS NOT NULL),
chosen_turns AS MATERIALIZED {_turns("c")}, rejected_turns AS MATERIALIZED {_turns("r")},
n AS MATERIALIZED (SELECT pair_id, CAST(coalesce(min(k) FILTER (NOT coalesce(x.role = y.role AND x.text = y.text, FALSE)) - 1, count(*)) AS INTEGER) AS n_prompt_turns
 FROM chosen_turns x FULL JOIN rejected_turns y USING (pair_id, k) GROUP BY pair_id),
q AS (SELECT pair_id, string_agg(body, '' ORDER BY k) AS prompt FROM chosen_turns JOIN n USING (pair_id) WHERE k <= n_prompt_turns GROUP BY pair_id)
SELECT pair_id, n_prompt_turns, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected, coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected_mask, '') AS rejected_mask
FROM n LEFT JOIN q USING (pair_id) LEFT JOIN {_side("chosen")} x USING (pair_id) LEFT JOIN {_side("rejected")} y USING (pair_id)"""
