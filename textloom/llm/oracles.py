"""SQL (DuckDB) that gives the rows of queries of this subpackage over whole tables, plainly and without their methods.

The other queries have none: op1, op5 need a tokenizer, op7 a parser, op8, op10 a learned model; op5 besides leaves open
which sequence a piece goes to.
"""

from __future__ import annotations

import re

from .chat import CLOSE, CONTROLS, OPEN

_WHITE = r"[\x20\x09-\x0D]"
_INK = r"[^\x20\x09-\x0D]"

#: The decision list that ``quality_rules.fit`` learns from the labels of sf0.01, as conjunctions; other labels give others.
LEARNED_RULES = (
    "chars_per_word > 5.611111111111112 AND distinct_share <= 0.8598105909030278",
    "distinct_share <= 0.5843892016176307",
)

OP2 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_INK}+') AS w FROM d),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_INK}') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM again, (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id),
counts AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_WHITE}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(list_distinct(w)) AS n_distinct FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, word_chars / greatest(n_words, 1) AS chars_per_word, n_distinct / greatest(n_words, 1) AS distinct_share FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {" OR ".join(f"({r})" for r in LEARNED_RULES)}) AS kept FROM judged"""

OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_INK}+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
num AS (SELECT s, row_number() OVER () AS k FROM (SELECT s FROM sh GROUP BY s HAVING count(*) > 1)),
k AS MATERIALIZED (SELECT doc_id, k FROM sh JOIN num ON num.s = sh.s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM k a JOIN k b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS node, y AS other FROM both_ways UNION SELECT r.node, b.y FROM reach r JOIN both_ways b ON r.other = b.x),
comp AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.node = d.doc_id"""

OP4 = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
pos AS (SELECT doc_id, t, unnest(range(1, octet_length(t) - 198)) AS p FROM d WHERE octet_length(t) >= 200),
often AS (SELECT hash(t[p:p+199]) AS h FROM pos GROUP BY ALL HAVING count(*) > 1),
starts AS (SELECT unnest(list({'doc_id': doc_id, 'p': p}), recursive := true) FROM pos WHERE hash(t[p:p+199]) IN (SELECT h FROM often) GROUP BY t[p:p+199] HAVING count(*) > 1),
runs AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CAST(coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 200, true) AS INTEGER) AS new FROM starts)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS low, a AS high, b FROM spans),
parts AS (SELECT doc_id, list([low, high] ORDER BY low) AS gaps, max(b) AS last, CAST(sum(b - high) AS BIGINT) AS n_removed, count(*) AS n_spans FROM gaps GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN gaps IS NULL THEN t ELSE list_reduce(list_transform(gaps, lambda g: t[g[1]:g[2]-1]), lambda x, y: x || y) || t[last:octet_length(t)] END) AS kept_sha256
FROM d LEFT JOIN parts ON parts.doc_id = d.doc_id"""

OP6 = """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.id AS query_id, b.id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.id <> b.id AND len(a.q) = len(b.q) WHERE a.id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 20"""

_ESCAPED = "|".join(["\\\\", *map(re.escape, CONTROLS)])
_TEMPLATE = len(OPEN) + len(CLOSE) + 2

OP9 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, {_TEMPLATE} + length(role) + len(regexp_extract_all(role, '{_ESCAPED}')) + length(role) - length(replace(role, chr(10), '')) + length(text) + len(regexp_extract_all(text, '{_ESCAPED}')) AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""

ORACLES = {
    "op2_quality_rules": OP2,
    "op3_near_duplicates": OP3,
    "op4_suffix_dedup": OP4,
    "op6_exact_top_k": OP6,
    "op9_chat_formatting": OP9,
}
