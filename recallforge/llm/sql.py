"""SQL for DuckDB beside the queries whose results it can express."""

# ruff: noqa: E501
from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII text, bit by bit."""
    bit = "list_reduce([{0}, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: {bit.format('xor(a, b)')}), 4294967295::UBIGINT)"


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes (g, level, i, h, n) of a tree over ``leaves`` (g, i, h, n)."""
    return f"""{name}(g, level, i, h, n) AS (
  SELECT g, 0, i, h, n FROM {leaves}
  UNION ALL SELECT g, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, level, i // 3, n)"""


def _steps(tree: str, leaves: str) -> str:
    """Per leaf (g, i) and level: the siblings before and after its node."""
    return f"""SELECT l.g, l.i, a.level, coalesce(string_agg(a.h, '' ORDER BY a.i) FILTER (WHERE a.i < l.i // p.p), '') AS before, coalesce(string_agg(a.h, '' ORDER BY a.i) FILTER (WHERE a.i > l.i // p.p), '') AS after
  FROM {leaves} l JOIN {tree} a ON a.g IS NOT DISTINCT FROM l.g AND a.n > 1 JOIN powers p ON p.level = a.level AND a.i // 3 = l.i // p.p // 3 GROUP BY l.g, l.i, a.level"""


OP13_SQL = f"""
WITH RECURSIVE powers AS (SELECT range AS level, CAST(pow(3, range) AS BIGINT) AS p FROM range(38)),
d AS (SELECT doc_id, source AS g, {_leaf('text')} AS h,
  CASE WHEN doc_id IS NOT NULL AND {crc32('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS claimed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree('nodes', 'leaves')},
subroots AS (SELECT g AS source, h AS subroot FROM nodes WHERE n = 1),
groups AS (SELECT 0 AS g, source, subroot AS h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM subroots),
{_tree('tops', 'groups')},
own AS ({_steps('nodes', 'leaves')}), up AS ({_steps('tops', 'groups')}),
steps AS (SELECT g, i, 0 AS part, level, before, after FROM own
  UNION ALL SELECT l.g, l.i, 1, up.level, up.before, up.after FROM leaves l JOIN groups ON groups.source IS NOT DISTINCT FROM l.g JOIN up ON up.i = groups.i),
paths AS (SELECT g, i, list(before || '|' || after ORDER BY part, level) AS path, string_agg(before || after, '' ORDER BY part, level) AS siblings FROM steps GROUP BY g, i),
found AS (SELECT l.doc_id, l.h AS leaf, s.subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
  list_reduce(list_prepend(l.claimed, coalesce(path, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.g LEFT JOIN paths p ON p.g IS NOT DISTINCT FROM l.g AND p.i = l.i)
SELECT *, folded_root = root AS verified FROM found
"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: By state: the state after up to two inserted rows, their audit, cost and text.
_INSERTS = ", ".join(
    f"({q}, {p}, '{'I' * len(rows)}', {5 * len(rows)}, {[r + ':' for r in rows]}::VARCHAR[])"
    for q in range(4)
    for rows, p in (((), q), (("assistant",) if q == 2 else ("user",), 3 if q == 2 else 2), (("assistant", "user") if q == 2 else ("user", "assistant"), 2 if q == 2 else 3))
)
_KEEPS = "(0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)"

OP11_SQL = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
f AS (SELECT *, {crc32('key')} % 20 AS fault FROM k),
d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS time FROM f WHERE fault <> 0),
o AS (SELECT conv_id, turn, role, text, rtrim(text, {_SPACES}) AS core, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS i FROM d),
m AS (SELECT *, core = '' AS blank, core <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(core, 1) NOT IN ('.', '!', '?') AS cut,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM o),
x AS (SELECT conv_id, turn, role, text, initial, i, blank, again, cut AND NOT blank AND NOT again AS cut, pair FROM m),
inserts(q, p, audit, cost, rows) AS (VALUES {_INSERTS}), keeps(p, initial, q) AS (VALUES {_KEEPS}),
steps AS (
  SELECT conv_id, i, p, p AS q, 'D' AS audit, 2 AS cost, []::VARCHAR[] AS rows FROM x, (VALUES (0), (1), (2), (3)) s(p)
  UNION ALL SELECT conv_id, i, p, q, 'K', CASE WHEN cut THEN 5 ELSE 0 END, [role || ':' || text] FROM x JOIN keeps USING (initial) WHERE NOT blank AND NOT again
  UNION ALL SELECT conv_id, i, p, CASE p WHEN 2 THEN 3 ELSE 2 END, 'R', CASE WHEN cut THEN 6 ELSE 1 END, [CASE p WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] FROM x, (VALUES (0), (1), (2), (3)) s(p) WHERE NOT blank AND NOT again),
best(conv_id, i, q, b) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0, 'audit': '', 'rows': []::VARCHAR[]}} FROM conversations
  UNION ALL SELECT b.conv_id, b.i + 1, s.q, min({{'cost': b.b.cost + n.cost + s.cost, 'audit': b.b.audit || n.audit || s.audit, 'rows': b.b.rows || n.rows || s.rows}})
  FROM best b JOIN inserts n ON n.q = b.q JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i AND s.p = n.p GROUP BY b.conv_id, b.i, s.q),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
  count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id),
done AS (SELECT b.conv_id, min({{'cost': b.b.cost + n.cost, 'audit': b.b.audit || n.audit, 'rows': b.b.rows || n.rows}}) AS b
  FROM best b JOIN inserts n ON n.q = b.q AND n.p IN (0, 3) LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.i = coalesce(c.n, 0) GROUP BY b.conv_id)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  d.b.cost::BIGINT AS cost, d.b.audit AS audit, sha256(array_to_string(d.b.rows, chr(10))) AS repaired_sha256
FROM done d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
"""
