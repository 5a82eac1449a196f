"""DuckDB SQL of the conversation operators, written another way than they work."""

from __future__ import annotations

# CRC-32 of an ASCII text, from its table of 256 remainders (one row, joined as ``crc``).
_CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS tbl)"""


def _crc(text: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), "
            "lambda c, b: xor(tbl[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)")


def _step(options: dict[str, str]) -> str:
    """The cheapest way on from each state before a row; from the last row to the first."""
    line = lambda name, rest: f"{name} || ':' || r.text || CASE WHEN {rest}.t = '' THEN '' ELSE chr(10) || {rest}.t END"
    name = {"u": "'user'", "a": "'assistant'"}
    follow = {"z": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    out = []
    for state, target in options.items():
        keep = " ".join(f"WHEN NOT r.must AND r.initial = '{i}' THEN {{'c': v.{to}.c + r.extra, 'a': 'K' || v.{to}.a, 't': {line('r.role', f'v.{to}')}}}" for i, to in follow[state].items())
        out.append(f"""list_min([{{'c': v.{state}.c + 2, 'a': 'D' || v.{state}.a, 't': v.{state}.t}}, CASE {keep} END,
    CASE WHEN NOT r.must THEN {{'c': v.{target}.c + 1 + r.extra, 'a': 'R' || v.{target}.a, 't': {line(name[target], f'v.{target}')}}} END]) AS {state}""")
    return ",\n  ".join(out)


def _insert(source: str, target: str) -> str:
    """Least of going on and of inserting an empty row that leads to ``target``."""
    name = {"u": "user", "a": "assistant"}[target.split(".")[-1][0]]
    return (f"list_min([{source}, {{'c': {target}.c + 5, 'a': 'I' || {target}.a, "
            f"'t': '{name}:' || CASE WHEN {target}.t = '' THEN '' ELSE chr(10) || {target}.t END}}])")


STRUCTURE_REPAIR = f"""
WITH RECURSIVE {_CRC},
src AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc),
dam AS (SELECT g, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
  CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS rep
  FROM src WHERE k <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, rep) AS n,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM dam),
seen AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY n) > 1 AS again, body = '' AS blank,
  NOT right(body, 1) IN ('.', '!', '?') AS cut, left(role, 1) AS initial,
  lag(left(role, 1)) OVER (PARTITION BY g ORDER BY n) AS before FROM num),
rows_ AS (SELECT g, n, role, text, initial, blank OR again AS must, CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM seen),
stats AS (SELECT g, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM seen GROUP BY g),
walk AS (
  SELECT g, n + 1 AS n, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS z, {{'c': 10::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS s,
    {{'c': 5::BIGINT, 'a': 'I', 't': 'assistant:'}} AS u, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS a FROM stats
  UNION ALL
  SELECT g, n, {_insert('z', 'u1')} AS z, {_insert('s', 'u1')} AS s, u1 AS u, {_insert('a', 'u0')} AS a
  FROM (SELECT g, n, z, s, a, u AS u0, {_insert('u', 'a')} AS u1 FROM (
    SELECT v.g, r.n, {_step({'z': 'u', 's': 'u', 'u': 'a', 'a': 'u'})}
    FROM walk v JOIN rows_ r ON r.g = v.g AND r.n = v.n - 1))),
ids AS (SELECT DISTINCT g, conv_id FROM src)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(z.c, 0)::BIGINT AS cost,
  coalesce(z.a, '') AS audit, sha256(coalesce(z.t, '')) AS repaired_sha256
FROM ids LEFT JOIN stats USING (g) LEFT JOIN (SELECT g, z FROM walk WHERE n = 1) USING (g)"""


PREFIX_TRIE = f"""
WITH {_CRC},
t AS (SELECT conv_id AS c, coalesce(text, '') AS x, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 100 AS b, {_crc('c::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT c FROM t), crc),
both_ AS (SELECT ids.c, 0 AS own, t.n, t.x, t.id FROM ids JOIN t ON t.c = ids.b AND t.n <= ids.h
  UNION ALL SELECT ids.c, 1, t.n, t.x, t.id FROM ids JOIN t ON t.c = ids.c AND t.n > ids.h),
turns AS (SELECT c, length(x) AS len, row_number() OVER w AS d, string_agg(id, '') OVER w AS path FROM both_ WINDOW w AS (PARTITION BY c ORDER BY own, n)),
members AS (SELECT c, d, path, len FROM turns UNION ALL SELECT c, 0, '', 0 FROM ids),
ended AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM (SELECT c, max_by(path, d) AS path FROM members GROUP BY c) GROUP BY path),
node AS (SELECT path, any_value(d) AS d, min(c) AS conv_id, count(*) AS n, any_value(len) AS len FROM members GROUP BY path),
kids AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
under AS (SELECT left(path, 64 * k) AS path, sum((n - 1) * len) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM full_ f JOIN under USING (path) LEFT JOIN ended USING (path)
LEFT JOIN node up ON f.d > 0 AND up.path = left(f.path, length(f.path) - 64)"""
