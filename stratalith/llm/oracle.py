"""The operators' results as SQL, for those that SQL can express."""

from __future__ import annotations

from . import chat_format, quality_rules, secrets

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
v AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM w),
i AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 7, 0) + 1)) AS i FROM v),
g AS (SELECT doc_id, array_to_string(words[i:i + 7], ' ') AS gram, list(i) AS places FROM i GROUP BY 1, 2 HAVING count(*) > 1),
s AS (SELECT doc_id, unnest(places) AS i FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM s) GROUP BY 1),
m AS (SELECT v.doc_id, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, coalesce(n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters FROM v LEFT JOIN c ON c.doc_id = v.doc_id)
"""
LEDGER_SQL, RULES_SQL = RULES_SQL, RULES_SQL + f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT ({' OR '.join(f'({r.fails})' for r in quality_rules.RULES)}) AS kept FROM m
"""


def _policy(p: quality_rules.Policy) -> str:
    """The rows of one policy: a rule fails alone if it is the only one of the policy that a document fails."""
    rules = {r.name: f"CAST(({r.fails}) AS INT)" for r in quality_rules.RULES if r.name in p.rules}
    total = " + ".join(rules.values())
    parts = [f"SELECT '{p.version}' AS policy, '{name}' AS rule, CAST(sum({fails}) AS BIGINT) AS failing, CAST(sum(CASE WHEN {total} = 1 THEN {fails} ELSE 0 END) AS BIGINT) AS failing_alone, count(*) AS documents FROM m" for name, fails in rules.items()]
    return " UNION ALL ".join(parts)


ABLATIONS_SQL = LEDGER_SQL + " UNION ALL ".join(map(_policy, quality_rules.POLICIES))

CONTAMINATION_SQL = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM k),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
l AS (SELECT DISTINCT n FROM q),
p AS (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM d, l),
h AS (SELECT doc_id, p.n, i, item FROM p JOIN q ON q.n = p.n AND q.gram = array_to_string(w[i:i + p.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

NEAR_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
r(node, seen) AS (SELECT a, a FROM e UNION SELECT node, b FROM r JOIN e ON seen = a),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON node = d.doc_id
"""

MARKS = "<|im_end|><|im_start|>assistant ok"

CHAT_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, turn, role, '{MARKS}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
u AS (SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS same, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS safe, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS safe_role FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  CAST(sum(length(safe) + CASE WHEN same THEN {len(chat_format.SEPARATOR)} ELSE {len(chat_format.START) + 1 + len(chat_format.END)} + length(safe_role) END) AS BIGINT) AS formatted_chars FROM u GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def _matches(k: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {k} AS number, '{rule.kind}' AS kind, i, whole[i] AS whole, CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS whole, regexp_extract_all(text, '{pattern}', {rule.group}) AS decisive, regexp_split_to_array(text, '{pattern}') AS gaps FROM d)) WHERE length(decisive[i]) >= {rule.least}"""


BASE = sum(r.base for r in secrets.RULES)
SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(_matches(k, r) for k, r in enumerate(secrets.RULES))}),
s AS (SELECT *, kind || ':' || start || ':' || start + length(whole) AS span FROM m),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.RULES if r.base)}, coalesce(string_agg(span, ',' ORDER BY start, number) FILTER (number < {BASE}), '') AS base, string_agg(span, ',' ORDER BY start, number) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in secrets.RULES if r.base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
n AS (SELECT a, count(*) AS n FROM e GROUP BY 1),
r(node, seen) AS (SELECT a, a FROM e UNION SELECT node, b FROM r JOIN e ON seen = a),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM v LEFT JOIN n ON a = vec_id LEFT JOIN c ON node = vec_id
"""


def _way(origin: str, cost: str, edits: str, line: str = "", when: str = "") -> str:
    """A step of the repair from one state: its ways' cost, audit and text so far, with those of this row (or null)."""
    made = f"{{'c': {origin}.c + {cost}, 'w': {origin}.w || '{edits}', 'r': {origin}.r || {line or chr(39) * 2}}}"
    return f"CASE WHEN {origin} IS NOT NULL{' AND ' + when if when else ''} THEN {made} END"


def _least(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _user(origin: str, inserted: str = "", before: str = "") -> list[str]:
    cost = f"{3 * len(inserted)} + CASE WHEN cut THEN 3 ELSE 0 END"
    return [
        _way(origin, cost, inserted + "K", f"{before}role || ':' || text || chr(10)", "NOT gone AND left(role, 1) = 'u'"),
        _way(origin, cost + " + 3", inserted + "R", f"{before}'user:' || text || chr(10)", "NOT gone"),
    ]


def _assistant(origin: str, inserted: str = "", before: str = "") -> list[str]:
    cost = f"{3 * len(inserted)} + CASE WHEN cut THEN 3 ELSE 0 END"
    return [
        _way(origin, cost, inserted + "K", f"{before}role || ':' || text || chr(10)", "NOT gone AND left(role, 1) = 'a'"),
        _way(origin, cost + " + 3", inserted + "R", f"{before}'assistant:' || text || chr(10)", "NOT gone"),
    ]


_USER_LINE, _ASSISTANT_LINE = "'user:' || chr(10) || ", "'assistant:' || chr(10) || "
_KEPT_SYSTEM = _way("e", "CASE WHEN cut THEN 3 ELSE 0 END", "K", "role || ':' || text || chr(10)", "NOT gone AND left(role, 1) = 's'")
_STATES = {
    "e": [_way("e", "4", "D")],
    "s": [_way("s", "4", "D"), _KEPT_SYSTEM],
    "u": [_way("u", "4", "D"), *_user("e"), *_user("s"), *_user("a"), *_user("u", "I", _ASSISTANT_LINE)],
    "a": [_way("a", "4", "D"), *_assistant("u"), *_assistant("e", "I", _USER_LINE), *_assistant("s", "I", _USER_LINE), *_assistant("a", "I", _USER_LINE)],
}
_ENDS = [_way("e", "0", ""), _way("a", "0", ""), _way("u", "3", "I", "'assistant:' || chr(10)"), _way("s", "6", "II", "'user:' || chr(10) || 'assistant:' || chr(10)")]

REPAIR_SQL = rf"""
WITH RECURSIVE b AS (SELECT list(list_reduce([i] || range(8), lambda x, k: CASE WHEN k >= 0 AND x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS codes FROM (SELECT unnest(range(256)) AS i)),
o AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS key, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (SELECT o.*, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(name, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda x, c: xor(x >> 8, codes[(xor(x, c) & 255) + 1])), 4294967295) % 20 AS kind FROM o, b),
d AS (SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(role) OVER (PARTITION BY key ORDER BY i) AS before FROM p),
q AS (SELECT key, i, role, text, blank OR again AS gone, cut FROM f),
k AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
  count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY 1),
z AS (SELECT {{'c': CAST(0 AS BIGINT), 'w': '', 'r': ''}} AS start),
t(key, i, e, s, u, a) AS (SELECT key, CAST(0 AS BIGINT), start, CASE WHEN n < 0 THEN start END, CASE WHEN n < 0 THEN start END, CASE WHEN n < 0 THEN start END FROM k, z
  UNION ALL SELECT t.key, q.i, {', '.join(_least(*ways) for ways in _STATES.values())} FROM t JOIN q ON q.key = t.key AND q.i = t.i + 1),
x AS (SELECT t.key, {_least(*_ENDS)} AS best FROM t JOIN k ON k.key = t.key AND t.i = k.n)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.w, '') AS audit, sha256(coalesce(left(best.r, length(best.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT key, conv_id FROM o) y LEFT JOIN k ON k.key = y.key LEFT JOIN x ON x.key = y.key
"""

ORACLE_SQL = {
    "op1_quality_rules": RULES_SQL,
    "op2_benchmark_decontamination": CONTAMINATION_SQL,
    "op5_minhash_near_dedup": NEAR_SQL,
    "op7_chat_formatting": CHAT_SQL,
    "op9_secret_scans": SECRETS_SQL,
    "op12_embedding_near_dedup": VECTORS_SQL,
    "op13_conversation_repair": REPAIR_SQL,
    "rule_ablations": ABLATIONS_SQL,
}
