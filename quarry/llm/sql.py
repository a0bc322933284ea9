"""SQL for DuckDB of the training-data queries that SQL can state."""

from __future__ import annotations

from quarry.llm.replies import FAILURE_CHARS, FAILURES, STAND_INS

_INVISIBLE = r"\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{00ad}\x{00a0}\x{180e}"
_SINGLE, *_PHRASES = STAND_INS.split("|")
_BARE = ", ".join(f"'{w}'" for w in [*_SINGLE.split(), *_PHRASES])
_M = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})[T\s]+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,]\d+)?\s*(Z|z|UTC|GMT)?([+-]\d{2}:?\d{2})?$"


def _visible(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[{_INVISIBLE}]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _group(k: int) -> str:
    return f"regexp_extract(s, '{_M}', {k})"


def _number(k: int) -> str:
    return f"coalesce(try_cast({_group(k)} AS BIGINT), 0)"


_OFFSET = f"CASE WHEN {_group(8)} = '' THEN 0 ELSE (CASE WHEN {_group(8)}[1] = '-' THEN -1 ELSE 1 END) * (try_cast(replace({_group(8)}, ':', '')[2:3] AS BIGINT) * 3600 + try_cast(replace({_group(8)}, ':', '')[4:5] AS BIGINT) * 60) END"
_DAY = f"try_cast(concat({_group(1)}, '-', lpad({_group(2)}, 2, '0'), '-', lpad({_group(3)}, 2, '0')) AS DATE)"

_TURNS = rf"""r AS (SELECT id, regexp_replace(session_id, '^[\s{_INVISIBLE}]+|[\s{_INVISIBLE}]+$', '', 'g') AS session_id, trim(asked_at) AS s, regexp_replace(coalesce(question, ''), '[\s{_INVISIBLE}]+', '', 'g') AS q,
coalesce(length({_visible('question')}) > 0, false) AS asked, {_visible('answer')} AS seen FROM turns WHERE id IS NOT NULL),
b AS (SELECT *, lower(regexp_replace(seen, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS bare,
CASE WHEN regexp_matches(s, '^\d{{9,11}}$') THEN try_cast(s AS BIGINT) WHEN regexp_matches(s, '^\d{{12,14}}$') THEN try_cast(s AS BIGINT) // 1000
WHEN regexp_matches(s, '{_M}') THEN date_diff('day', DATE '1970-01-01', {_DAY}) * 86400 + {_number(4)} * 3600 + {_number(5)} * 60 + {_number(6)} - ({_OFFSET}) END AS at_s FROM r WHERE length(session_id) > 0),
t AS (SELECT session_id, at_s, q, min(id) AS turn_id, bool_or(asked) AND at_s IS NOT NULL AND bool_or(coalesce(length(bare) > 0 AND bare NOT IN ({_BARE}) AND NOT (length(seen) <= {FAILURE_CHARS} AND regexp_matches(lower(seen), '{FAILURES.replace("'", "''")}')), false)) AS good FROM b GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_s, turn_id) AS n, bool_and(good) OVER (PARTITION BY session_id) AS whole FROM t)"""

SQL = {
    "p1_found": f"""WITH {_TURNS}, m AS (SELECT session_id, 2 * n - 1 AS msg_no, 'user' AS role, turn_id FROM k WHERE whole UNION ALL SELECT session_id, 2 * n, 'assistant', turn_id FROM k WHERE whole)
SELECT session_id, CAST(msg_no AS INT) AS msg_no, role, turn_id FROM m""",
    "p1_session_report": f"""WITH {_TURNS}, o AS (SELECT session_id, count(*) AS n, bool_and(good) AS w, bool_or(good) AS a FROM t GROUP BY 1)
SELECT CASE WHEN w THEN 'kept' WHEN a THEN 'incomplete' ELSE 'without_reply' END AS outcome, count(*) AS sessions, sum(n)::BIGINT AS turns FROM o GROUP BY 1""",
}
