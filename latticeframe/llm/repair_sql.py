"""SQL of the conversation repair: the grammar is regular, so SQL reads each conversation row by row.

A row of ``parse`` holds the least (cost, audit) of the four states after so many rows of its conversation.
"""

from __future__ import annotations

NEVER = "{'c': 1000000000::BIGINT, 'a': ''}"
STAY = "CASE WHEN fault IN (1, 2) THEN 1000000000 WHEN fault = 3 THEN 5 ELSE 0 END"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _edit(state: str, cost: str, letter: str) -> str:
    return f"{{'c': ({state}).c + {cost}, 'a': ({state}).a || '{letter}'}}"


def _keep(state: str, initial: str) -> str:
    return _edit(state, f"({STAY} + CASE WHEN initial = '{initial}' THEN 0 ELSE 1000000000 END)", "K")


def _rerole(state: str) -> str:
    return _edit(state, f"({STAY} + 1)", "R")


def _closed(source: str) -> str:
    """States after insertions: a user turn after states 0, 1 and 3, an assistant turn after state 2."""
    user = _least("t2", *[_edit(t, "5", "I") for t in ("t0", "t1", "t3")])
    assistant = _least("t3", _edit("u2", "5", "I"))
    return f"SELECT conv_id, pos, t0 AS s0, t1 AS s1, u2 AS s2, {assistant} AS s3 FROM (SELECT *, {user} AS u2 FROM {source})"


def _step() -> str:
    before_user = ("s0", "s1", "s3")
    t0 = _edit("s0", "2", "D")
    t1 = _least(_edit("s1", "2", "D"), _keep("s0", "s"))
    t2 = _least(_edit("s2", "2", "D"), *[_keep(s, "u") for s in before_user], *[_rerole(s) for s in before_user])
    t3 = _least(_edit("s3", "2", "D"), _keep("s2", "a"), _rerole("s2"))
    joined = "parse p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos + 1"
    return f"(SELECT p.conv_id, r.pos, {t0} AS t0, {t1} AS t1, {t2} AS t2, {t3} AS t3 FROM {joined})"


def repair_sql(crc32) -> str:
    """Damage, faults, parse and repaired texts; ``crc32`` gives the SQL of a text's checksum."""
    start = f"(SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': ''}} AS t0, {NEVER} AS t1, {NEVER} AS t2, {NEVER} AS t3 FROM facts)"
    return f"""
WITH RECURSIVE f AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
k AS (SELECT *, {crc32("name")} % 20 AS kind FROM f),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS time FROM k),
o AS (
  SELECT *, row_number() OVER w AS pos, substr(role, 1, 1) AS initial, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    lag(substr(role, 1, 1)) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time)),
r AS (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate,
    count_if(fault = 3) AS truncated, count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
parse AS ({_closed(start)} UNION ALL {_closed(_step())}),
best AS (SELECT f.*, {_least("s0", "s3")} AS b FROM parse p JOIN facts f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.pos),
letters AS (SELECT conv_id, unnest(string_split(b.a, '')) AS letter, unnest(range(1, length(b.a) + 1)) AS j FROM best WHERE b.a <> ''),
placed AS (
  SELECT *, count_if(letter <> 'I') OVER w AS pos, count_if(letter <> 'D') OVER w - 1 AS seq, count_if(letter <> 'D') OVER (PARTITION BY conv_id) % 2 AS system
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
turns AS (
  SELECT p.conv_id, p.j, CASE WHEN letter = 'K' THEN role WHEN (seq - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END AS turn
  FROM placed p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos WHERE letter <> 'D'),
texts AS (SELECT conv_id, string_agg(turn, chr(10) ORDER BY j) AS body FROM turns GROUP BY conv_id)
SELECT c.conv_id, coalesce(b.gaps, 0) AS gaps, coalesce(b.blank, 0) AS blank, coalesce(b.duplicate, 0) AS duplicate, coalesce(b.truncated, 0) AS truncated,
  coalesce(b.illegal, 0) AS illegal, coalesce(b.b.c, 0) AS cost, coalesce(b.b.a, '') AS audit, sha256(coalesce(t.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
