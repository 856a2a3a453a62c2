"""Queries over status history, audio buffers and latest rows
(A4, A5, P2, W2-W5, W8, L2)."""

from __future__ import annotations

from agendum.operators import history as H
from agendum.operators import relational as R
from agendum.plans.common import rounded
from agendum.plans.registry import query
from agendum.plans.sqlviews import (AUDIO_CHUNKS, ORDERED_TRANSCRIPTS, TICKET_HISTORY,
                                    TICKETS, with_views)
from agendum.sources import testdata as td

PATTERN_MEETING = 8   # P2 reads the pattern rows of one meeting: that filter is the operator
ORDER_SQL = "changed_at, " + ", ".join(td.HISTORY_TIEBREAK)


def history_df(spark, d):
    return H.derive_history(td.ticket_history(spark, d), ts="changed_at", status="new_status",
                            tiebreak=td.HISTORY_TIEBREAK)


_HISTORY_SQL = f"""
, x AS (SELECT ticket_id, changed_at, history_id, {', '.join(td.HISTORY_TIEBREAK)}, new_status,
               lag(new_status) OVER (PARTITION BY ticket_id ORDER BY {ORDER_SQL}) AS old_status
        FROM h)
, hist AS (SELECT * FROM x WHERE old_status IS DISTINCT FROM new_status)
"""


@query("status_changes", sql=with_views("""
SELECT ticket_id, count(history_id) AS status_change_count,
       round(avg(datediff('day', created_at, changed_at)), 6) AS avg_days_to_change
FROM h JOIN t USING (ticket_id) GROUP BY ticket_id""", h=TICKET_HISTORY, t=TICKETS))
def q_status_changes(spark, d):
    return rounded(H.status_changes(td.ticket_history(spark, d), td.tickets(spark, d)))


_PATTERNS_SQL = f"""
, s AS (SELECT ticket_id, avg(datediff('day', created_at, changed_at)) AS d
        FROM h JOIN t USING (ticket_id) GROUP BY ticket_id)
, p AS (SELECT meeting_id, round(avg(d), 6) AS avg_status_change_duration,
               CAST(sum(CASE WHEN regexp_matches(content, '{td.ORDER_BLOCKER_PATTERN}') THEN 1 ELSE 0 END) AS BIGINT)
                 AS blocker_count,
               count(*) AS ticket_count
        FROM t LEFT JOIN s USING (ticket_id) GROUP BY meeting_id)
"""


def patterns_df(spark, d):
    return H.ticket_patterns(td.ticket_history(spark, d), td.tickets(spark, d), td.ORDER_BLOCKER_PATTERN)


@query("ticket_patterns", sql=with_views(_PATTERNS_SQL + "SELECT * FROM p", h=TICKET_HISTORY, t=TICKETS))
def q_ticket_patterns(spark, d):
    return rounded(patterns_df(spark, d))


_DATED = _PATTERNS_SQL + f"""
, q AS (SELECT meeting_id, CAST(date_trunc('year', created_at) + INTERVAL 1 YEAR AS DATE) AS analysis_date,
               round(avg(d), 6) AS avg_status_change_duration,
               CAST(sum(CASE WHEN regexp_matches(content, '{td.ORDER_BLOCKER_PATTERN}') THEN 1 ELSE 0 END) AS BIGINT) AS blocker_count,
               count(*) AS ticket_count
        FROM t LEFT JOIN s USING (ticket_id) GROUP BY ALL)
"""


def dated_patterns_df(spark, d):
    return H.ticket_patterns(td.ticket_history(spark, d), td.tickets(spark, d), td.ORDER_BLOCKER_PATTERN, "year")


@query("ticket_patterns_yearly", sql=with_views(_DATED + "SELECT * FROM q", h=TICKET_HISTORY, t=TICKETS))
def q_ticket_patterns_yearly(spark, d):
    return rounded(dated_patterns_df(spark, d))


@query("patterns_for_meeting", sql=with_views(
    _DATED + f"SELECT * FROM q WHERE meeting_id = {PATTERN_MEETING}", h=TICKET_HISTORY, t=TICKETS))
def q_patterns_for_meeting(spark, d):
    return rounded(R.patterns_for_meeting(dated_patterns_df(spark, d), PATTERN_MEETING))


@query("derive_history", sql=with_views(
    _HISTORY_SQL + "SELECT ticket_id, changed_at, history_id, old_status, new_status FROM hist", h=TICKET_HISTORY))
def q_derive_history(spark, d):
    return history_df(spark, d).select("ticket_id", "changed_at", "history_id", "old_status", "new_status")


def _allowed_sql() -> str:
    return " OR ".join(f"(old_status = '{a}' AND new_status = '{b}')" for a, b in H.ALLOWED_TRANSITIONS)


@query("invalid_transitions", sql=with_views(
    _HISTORY_SQL + f"""SELECT ticket_id, changed_at, history_id, old_status, new_status FROM hist
WHERE old_status IS NOT NULL AND NOT coalesce({_allowed_sql()}, false)""", h=TICKET_HISTORY))
def q_invalid_transitions(spark, d):
    return H.check_transitions(history_df(spark, d)).select(
        "ticket_id", "changed_at", "history_id", "old_status", "new_status")


@query("status_dwell", sql=with_views(_HISTORY_SQL + f"""
, dd AS (SELECT new_status, changed_at,
                lead(changed_at) OVER (PARTITION BY ticket_id ORDER BY {ORDER_SQL}) AS nx FROM hist)
, a AS (SELECT new_status AS status, count(*) AS transitions,
               avg(CAST(floor(epoch(nx)) AS BIGINT) - CAST(floor(epoch(changed_at)) AS BIGINT)) AS avg_dwell_sec
        FROM dd WHERE nx IS NOT NULL GROUP BY 1)
SELECT status, transitions, round(avg_dwell_sec, 6) AS avg_dwell_sec,
       rank() OVER (ORDER BY avg_dwell_sec DESC) = 1 AS is_bottleneck
FROM a""", h=TICKET_HISTORY))
def q_status_dwell(spark, d):
    return rounded(H.status_dwell(history_df(spark, d), tiebreak=td.HISTORY_TIEBREAK))


@query("chunk_flush_groups", sql=with_views(f"""
, r AS (SELECT *, n_bytes < {td.SHORT_CHUNK_BYTES} AS short,
               CAST(coalesce(sum(CASE WHEN n_bytes < {td.SHORT_CHUNK_BYTES} THEN 1 ELSE 0 END)
                    OVER (PARTITION BY meeting_id ORDER BY seq
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment
        FROM c)
, g AS (SELECT *, (row_number() OVER (PARTITION BY meeting_id, segment ORDER BY seq) - 1) // 5 AS group_no FROM r)
SELECT meeting_id, segment, CAST(group_no AS BIGINT) AS group_no, min(seq) AS first_seq, max(seq) AS last_seq,
       count(*) AS n_chunks, CAST(sum(n_bytes) AS BIGINT) AS total_bytes,
       CASE WHEN count(*) = 5 THEN 'full' WHEN bool_or(short) THEN 'short' ELSE 'open' END AS flush_reason
FROM g GROUP BY meeting_id, segment, group_no""", c=AUDIO_CHUNKS))
def q_chunk_flush_groups(spark, d):
    return H.chunk_flush_groups(td.audio_chunks(spark, d), buffer_size=5, chunk_size=td.SHORT_CHUNK_BYTES)


_LATEST_SQL = """
, latest AS (SELECT audio_id, meeting_id, seq, speaker, text FROM
             (SELECT *, row_number() OVER (PARTITION BY audio_id ORDER BY seq DESC) AS rn FROM ot) WHERE rn = 1)
"""


def latest_df(spark, d):
    return R.latest_by_key(td.ordered_transcripts(spark, d), ["audio_id"], ["seq"])


@query("latest_transcript", sql=with_views(_LATEST_SQL + "SELECT * FROM latest", ot=ORDERED_TRANSCRIPTS))
def q_latest_transcript(spark, d):
    return latest_df(spark, d)


@query("first_meeting_row", sql=with_views(_LATEST_SQL + """
SELECT meeting_id, audio_id, seq, speaker, text FROM
  (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY audio_id) AS rn FROM latest) WHERE rn = 1""",
    ot=ORDERED_TRANSCRIPTS))
def q_first_meeting_row(spark, d):
    return R.first_row(latest_df(spark, d), ["meeting_id"], "audio_id")
