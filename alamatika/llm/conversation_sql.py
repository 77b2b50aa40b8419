"""Reference SQL (DuckDB) of the operators on conversations: trie and repair."""

from __future__ import annotations


def crc32(s: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = f"[(unicode(substr({s}, 1 + k // 8, 1)) >> (k % 8)) & 1 FOR k IN range(8 * length({s}))]"
    return (
        f"xor(list_reduce([CAST(b AS BIGINT) FOR b IN {bits}], "
        "lambda x, b: xor(x >> 1, 3988292384 * (xor(x, b) & 1)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
    )


TRIE = f"""
WITH t AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS s
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
  WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, s, {crc32('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM t),
r AS (
  SELECT h.conv_id, list_concat(coalesce(o.s[1:h], []), h.s[h + 1:]) AS s
  FROM h LEFT JOIN t o ON o.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, s[1:d] AS pre, len(s) = d AS ends FROM r, unnest(range(len(s) + 1)) AS u(d)),
n AS (
  SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends
  FROM p GROUP BY pre, d),
c AS (SELECT pre[1:d - 1] AS pre, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
k AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    (n_convs - 1) * CASE WHEN n.d = 0 THEN 0 ELSE length(n.pre[n.d].text) END AS saved
  FROM n LEFT JOIN c ON c.pre = n.pre AND c.d = n.d),
up AS (
  SELECT pre[1:e] AS pre, e AS d, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
    CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM k, unnest(range(d + 1)) AS u(e) GROUP BY ALL)
SELECT k.conv_id, k.d AS depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens,
  sha256(k.ends) AS ends_sha256
FROM k JOIN up ON up.pre = k.pre AND up.d = k.d
LEFT JOIN n q ON k.d > 0 AND q.pre = k.pre[1:k.d - 1] AND q.d = k.d - 1"""


def _add(state: str, cost: str, letter: str) -> str:
    """A state is its cost in nine digits and its audit, so the least text is the best."""
    return f"lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letter}'"


def _step() -> str:
    """One element of the walk: an insertion of a user (U) or assistant (A), or a row."""
    z, s, u, a = (f"m[{i}]" for i in range(1, 5))
    e = "CAST(x[2] AS BIGINT)"

    def keep(state: str, kind: str) -> str:
        return _add(state, f"CASE WHEN x[1] = '{kind}' THEN {e} ELSE 900000000 END", "K")

    gone = [_add(v, "4", "D") for v in (z, s, u, a)]
    to_user = [f"{keep(v, 'u')}, {_add(v, f'3 + {e}', 'R')}" for v in (z, s, a)]
    return f"""CASE x[1]
    WHEN 'U' THEN [{z}, {s}, least({u}, {_add(z, '3', 'I')}, {_add(s, '3', 'I')}, {_add(a, '3', 'I')}), {a}]
    WHEN 'A' THEN [{z}, {s}, {u}, least({a}, {_add(u, '3', 'I')})]
    WHEN 'X' THEN [{', '.join(gone)}]
    ELSE [{gone[0]}, least({gone[1]}, {keep(z, 's')}), least({gone[2]}, {', '.join(to_user)}),
      least({gone[3]}, {keep(u, 'a')}, {_add(u, f'3 + {e}', 'R')})] END"""


REPAIR = f"""
WITH o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS (SELECT *, {crc32('key')} % 20 AS b FROM o),
w AS (
  SELECT conv_id, turn, CASE WHEN b = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN b = 1 THEN '' WHEN b = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM f, unnest(range(CASE WHEN b = 3 THEN 2 ELSE 1 END)) AS u(i) WHERE b <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM w),
d AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM n),
g AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault FROM d),
q AS (
  SELECT conv_id, list_concat([['U', '', '', ''], ['A', '', '', '']], flatten(list(
    [[CASE WHEN fault IN ('blank', 'duplicate') THEN 'X' WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END,
      CASE WHEN fault = 'truncated' THEN '3' ELSE '0' END, '', ''], ['U', '', '', ''], ['A', '', '', '']] ORDER BY pos))) AS steps
  FROM g GROUP BY conv_id),
best AS (
  SELECT conv_id, list_reduce(steps, lambda m, x: {_step()},
    ['000000000', '900000000', '900000000', '900000000']) AS m FROM q),
won AS (SELECT conv_id, CAST(left(least(m[1], m[4]), 9) AS BIGINT) AS cost, substr(least(m[1], m[4]), 10) AS audit FROM best),
letters AS (
  SELECT conv_id, i, substr(audit, i, 1) AS edit,
    length(regexp_replace(left(audit, i), 'I', '', 'g')) AS pos,
    length(regexp_replace(left(audit, i), 'D', '', 'g')) AS place
  FROM won, unnest(range(1, length(audit) + 1)) AS u(i)),
read AS (
  SELECT l.*, g.role, g.text, place - max(CASE WHEN place = 1 AND edit = 'K' AND left(g.role, 1) = 's' THEN 1 ELSE 0 END)
    OVER (PARTITION BY l.conv_id) AS parity
  FROM letters l LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM l.conv_id AND g.pos = l.pos AND edit <> 'I'
  WHERE edit <> 'D'),
fixed AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN parity % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS body FROM read GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pos > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts USING (conv_id) LEFT JOIN won USING (conv_id) LEFT JOIN fixed USING (conv_id)"""
