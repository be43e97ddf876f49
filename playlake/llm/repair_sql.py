"""The repair of conversations as SQL: least (cost, edits) of each state of the pattern, row by row."""

from __future__ import annotations


def crc32_sql(numbers: str) -> str:
    """The unsigned crc32 of a list of bytes."""
    shifted = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda a, b: {shifted}), 4294967295)"


def _edited(state: str, cost: str, letter: str, line: str | None, when: str = "true") -> str:
    lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {lines}}} END"


def _reached(initial: str, role: str, *states: str) -> str:
    """Keep or rerole from any of the states."""
    ways = [w for s in states for w in (_edited(s, "extra", "K", "role || ':' || text", f"NOT must AND initial = '{initial}'"), _edited(s, "2 + extra", "R", f"'{role}:' || text", "NOT must"))]
    return ", ".join(ways)


_NONE = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
REPAIR_SQL = f"""
    WITH RECURSIVE
    original AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    sums AS (SELECT k, {crc32_sql("list_transform(range(1, len(k) + 1), lambda i: ord(substr(k, i, 1))::BIGINT)")} % 20 AS d FROM (SELECT DISTINCT k FROM original)),
    damaged AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                       unnest(range(0, CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM original JOIN sums USING (k)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {_BLANKS}) AS bare FROM damaged),
    marked AS (SELECT *, left(role, 1) AS initial, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
                      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
    faulty AS (SELECT *, blank OR duplicate AS must, NOT blank AND NOT duplicate AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM marked),
    whole AS (SELECT *, cut::BIGINT AS extra FROM faulty),
    walk AS (
        SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS p0, {_NONE} AS p1, {{'c': 2::BIGINT, 'a': 'I', 't': ['user:']}} AS p2, {{'c': 4::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS p3
        FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT conv_id, i, n0 AS p0, n1 AS p1, m2 AS p2, least(n3, {_edited("m2", "2", "I", "'assistant:'")}) AS p3
        FROM (SELECT *, least(n2, {_edited("n0", "2", "I", "'user:'")}, {_edited("n1", "2", "I", "'user:'")}, {_edited("n3", "2", "I", "'user:'")}) AS m2
              FROM (SELECT w.conv_id, r.i, {_edited("p0", "3", "D", None)} AS n0,
                           least({_edited("p1", "3", "D", None)}, {_edited("p0", "extra", "K", "role || ':' || text", "NOT must AND initial = 's'")}) AS n1,
                           least({_edited("p2", "3", "D", None)}, {_reached("u", "user", "p0", "p1", "p3")}) AS n2,
                           least({_edited("p3", "3", "D", None)}, {_reached("a", "assistant", "p2")}) AS n3
                    FROM walk w JOIN whole r ON r.i = w.i + 1 AND r.conv_id IS NOT DISTINCT FROM w.conv_id))),
    ends AS (SELECT conv_id, arg_max(least(p0, p3), i) AS e FROM walk GROUP BY conv_id),
    stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (duplicate)::BIGINT AS duplicate,
                     count(*) FILTER (cut)::BIGINT AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM whole GROUP BY conv_id)
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           e.e.c AS cost, e.e.a AS audit, sha256(array_to_string(e.e.t, chr(10))) AS repaired_sha256
    FROM ends e LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM e.conv_id"""
