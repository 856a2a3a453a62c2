"""Queries over the windowed metric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from agendum.operators import metrics as M
from agendum.plans.common import rounded
from agendum.plans.registry import query
from agendum.plans.sqlviews import (LATENCY, MEETINGS, TICKET_EVENTS, TICKET_HISTORY,
                                    TICKETS, TIMED_TRANSCRIPTS, GROUP_MEMBERS, with_views)
from agendum.sources import testdata as td

# The events table spans one month, so metric windows are a day (or an hour
# where the hour of day matters) instead of the streaming default minute.
DAY = "1 day"
HOUR = "1 hour"
REALTIME_MEETING = 8      # P1/P2 read the metrics of one meeting: that filter is the operator


def _sql_bucket(ts: str, interval: str) -> str:
    return f"time_bucket(INTERVAL '{interval}', {ts})"


def realtime_scores(spark, d, window=DAY):
    return M.productivity_score(td.timed_transcripts(spark, d), td.ticket_events(spark, d), window)


def _score_sql(interval: str) -> str:
    b = _sql_bucket("ts", interval)
    return with_views(f"""
, seg AS (SELECT {b} AS ws, meeting_id, count(*) AS segment_count FROM tt GROUP BY ALL)
, tck AS (SELECT {b} AS ws, meeting_id, count(ticket_id) AS ticket_count,
                 CAST(sum(CASE WHEN status <> 'TODO' THEN 1 ELSE 0 END) AS BIGINT) AS actionable_tickets
          FROM te GROUP BY ALL)
, rt AS (SELECT ws AS window_start, ws + INTERVAL '{interval}' AS window_end, meeting_id, segment_count,
                ticket_count, actionable_tickets,
                actionable_tickets * CAST(0.6 AS DOUBLE) + ticket_count * CAST(0.4 AS DOUBLE) AS productivity_score
         FROM seg JOIN tck USING (ws, meeting_id))
""", tt=TIMED_TRANSCRIPTS, te=TICKET_EVENTS)


def score_cte(interval: str) -> str:
    """SQL prefix defining ``rt`` (realtime metrics) for the given window."""
    return _score_sql(interval)


@query("ticket_counts", sql=with_views(f"""
SELECT {_sql_bucket('ts', DAY)} AS window_start, {_sql_bucket('ts', DAY)} + INTERVAL '{DAY}' AS window_end,
       meeting_id, count(ticket_id) AS ticket_count,
       CAST(sum(CASE WHEN status <> 'TODO' THEN 1 ELSE 0 END) AS BIGINT) AS actionable_tickets
FROM te GROUP BY ALL""", te=TICKET_EVENTS))
def q_ticket_counts(spark, d):
    return M.ticket_counts(td.ticket_events(spark, d), DAY)


@query("productivity_score", sql=score_cte(DAY) + """
SELECT window_start, window_end, meeting_id, segment_count, ticket_count, actionable_tickets,
       round(productivity_score, 6) AS productivity_score,
       round(productivity_score / ticket_count, 6) AS productivity_ratio
FROM rt""")
def q_productivity_score(spark, d):
    return rounded(realtime_scores(spark, d))


def ticket_metrics_df(spark, d, window=DAY):
    return M.ticket_metrics(td.ticket_events(spark, d), window, td.EVENT_BLOCKER_PATTERN)


def ticket_metrics_sql(interval: str) -> str:
    b = _sql_bucket("ts", interval)
    return f"""
SELECT {b} AS window_start, {b} + INTERVAL '{interval}' AS window_end, meeting_id,
       CAST(sum(CASE WHEN status <> 'TODO' THEN 1 ELSE 0 END) AS BIGINT) AS actionable_items_count,
       count(status) AS status_updates_count,
       CAST(sum(CASE WHEN regexp_matches(content, '{td.EVENT_BLOCKER_PATTERN}') THEN 1 ELSE 0 END) AS BIGINT)
         AS blockers_mentioned
FROM te GROUP BY ALL"""


@query("ticket_metrics", sql=with_views(ticket_metrics_sql(DAY), te=TICKET_EVENTS))
def q_ticket_metrics(spark, d):
    return ticket_metrics_df(spark, d)


@query("blocker_alerts", sql=with_views(
    "SELECT * FROM (" + ticket_metrics_sql(DAY) + ") WHERE blockers_mentioned >= 2", te=TICKET_EVENTS))
def q_blocker_alerts(spark, d):
    return M.blocker_alerts(ticket_metrics_df(spark, d), min_count=2)


@query("realtime_for_meeting", sql=score_cte(DAY) + f"""
SELECT window_start, window_end, meeting_id, round(productivity_score, 6) AS productivity_score,
       ticket_count, actionable_tickets
FROM rt WHERE meeting_id = {REALTIME_MEETING}""")
def q_realtime_for_meeting(spark, d):
    from agendum.operators.relational import realtime_for_meeting
    rt = realtime_scores(spark, d).select("window_start", "window_end", "meeting_id",
                                          "productivity_score", "ticket_count", "actionable_tickets")
    return rounded(realtime_for_meeting(rt, REALTIME_MEETING))


@query("hourly_pattern", sql=score_cte(HOUR) + """
SELECT CAST(hour(window_start) AS INTEGER) AS hour_of_day, round(avg(productivity_score), 6) AS avg_score,
       count(meeting_id) AS meeting_count, count(DISTINCT meeting_id) AS distinct_meetings
FROM rt GROUP BY ALL""")
def q_hourly_pattern(spark, d):
    return rounded(M.hourly_pattern(realtime_scores(spark, d, HOUR)))


@query("hourly_patterns", sql=score_cte(HOUR) + """
SELECT CAST(hour(window_start) AS INTEGER) AS hour_of_day, round(avg(productivity_score), 6) AS avg_score,
       count(meeting_id) AS meeting_count
FROM rt GROUP BY ALL""")
def q_hourly_patterns(spark, d):
    from agendum.operators.relational import hourly_patterns
    pat = M.hourly_pattern(realtime_scores(spark, d, HOUR)).drop("distinct_meetings")
    return rounded(hourly_patterns(pat))


def history_with_created(spark, d):
    h = td.ticket_history(spark, d)
    t = td.tickets(spark, d).select("ticket_id", "created_at")
    return h.join(t, "ticket_id", "inner")


@query("workflow_times", sql=with_views("""
SELECT new_status AS status, count(h.ticket_id) AS ticket_count,
       round(avg(CAST(floor(epoch(changed_at)) AS BIGINT) - CAST(floor(epoch(created_at)) AS BIGINT)), 6)
         AS avg_time_in_status
FROM h JOIN t USING (ticket_id) GROUP BY ALL""", h=TICKET_HISTORY, t=TICKETS))
def q_workflow_times(spark, d):
    ev = history_with_created(spark, d)
    return rounded(M.workflow_times(ev, status="new_status", ts="changed_at"))


@query("completion_rate", sql=with_views("""
SELECT group_id, time_bucket(INTERVAL '7 days', created_at) AS week_start, count(*) AS ticket_count,
       CAST(sum(CASE WHEN status = 'DONE' THEN 1 ELSE 0 END) AS BIGINT) AS done_count,
       round(sum(CASE WHEN status = 'DONE' THEN 1 ELSE 0 END) / count(*), 6) AS completion_rate
FROM t JOIN m USING (meeting_id) GROUP BY ALL""", t=TICKETS, m=MEETINGS))
def q_completion_rate(spark, d):
    return rounded(M.completion_rate(td.tickets(spark, d), td.meetings(spark, d)))


@query("board_counts", sql=with_views("""
SELECT CASE WHEN grouping(status) = 1 THEN 'All' ELSE status END AS status, count(*) AS ticket_count
FROM t GROUP BY ROLLUP (status)""", t=TICKETS))
def q_board_counts(spark, d):
    return M.board_counts(td.tickets(spark, d))


@query("daily_activity", sql=with_views("""
, m AS (SELECT CAST(ts AS DATE) AS activity_date, count(DISTINCT meeting_id) AS meetings FROM tt GROUP BY ALL)
, k AS (SELECT CAST(created_at AS DATE) AS activity_date, count(*) AS tickets FROM t GROUP BY ALL)
SELECT coalesce(m.activity_date, k.activity_date) AS activity_date,
       coalesce(meetings, 0) AS meetings, coalesce(tickets, 0) AS tickets
FROM m FULL OUTER JOIN k ON m.activity_date = k.activity_date""",
    tt=TIMED_TRANSCRIPTS, t=TICKETS))
def q_daily_activity(spark, d):
    return M.daily_activity(td.timed_transcripts(spark, d), td.tickets(spark, d))


_SUMMARY_SQL = """
SELECT meeting_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS segment_count,
       CAST(min(ts) AS DATE) AS meeting_date,
       CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) AS duration_sec
FROM tt GROUP BY meeting_id"""


@query("meeting_summary", sql=with_views(_SUMMARY_SQL, tt=TIMED_TRANSCRIPTS))
def q_meeting_summary(spark, d):
    return M.meeting_summary(td.timed_transcripts(spark, d))


@query("kpi_totals", sql=with_views("""
SELECT 'meetings' AS kpi, CAST(count(*) AS DOUBLE) AS value FROM s
UNION ALL SELECT 'tickets', CAST(count(*) AS DOUBLE) FROM t
UNION ALL SELECT 'participants', CAST(count(DISTINCT user_id) AS DOUBLE) FROM gm
UNION ALL SELECT 'avg_duration_min', round(avg(duration_sec) / 60.0, 6) FROM s""",
    tt=TIMED_TRANSCRIPTS, s=_SUMMARY_SQL, t=TICKETS, gm=GROUP_MEMBERS))
def q_kpi_totals(spark, d):
    return rounded(M.kpi_totals(td.timed_transcripts(spark, d), td.tickets(spark, d),
                                td.group_members(spark, d)))


@query("latency_stats", sql=with_views("""
, v AS (SELECT 'kafka_delivery_ms' AS metric, CAST(kafka_delivery_ms AS DOUBLE) AS v FROM lat
        UNION ALL SELECT 'processing_ms', CAST(processing_ms AS DOUBLE) FROM lat
        UNION ALL SELECT 'total_ms', CAST(total_ms AS DOUBLE) FROM lat)
SELECT metric, count(*) AS n, round(avg(v), 6) AS avg, round(max(v), 6) AS max,
       round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95
FROM v WHERE v IS NOT NULL GROUP BY metric""", lat=LATENCY))
def q_latency_stats(spark, d):
    return rounded(M.latency_stats(td.latency(spark, d)))


@query("meeting_efficiency", sql=with_views("""
, s AS (SELECT meeting_id, count(*) AS segment_count,
               CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) AS duration_sec
        FROM tt GROUP BY meeting_id)
, a AS (SELECT meeting_id, CAST(sum(CASE WHEN status <> 'TODO' THEN 1 ELSE 0 END) AS BIGINT) AS actionable_tickets
        FROM te GROUP BY meeting_id)
SELECT meeting_id, segment_count, duration_sec, actionable_tickets,
       round(CASE WHEN segment_count = 0 THEN NULL ELSE actionable_tickets / segment_count END, 6)
         AS actionable_per_segment,
       round(CASE WHEN duration_sec = 0 THEN NULL ELSE actionable_tickets * 60.0 / duration_sec END, 6)
         AS actionable_per_minute
FROM s JOIN a USING (meeting_id)""", tt=TIMED_TRANSCRIPTS, te=TICKET_EVENTS))
def q_meeting_efficiency(spark, d):
    return rounded(M.meeting_efficiency(td.timed_transcripts(spark, d), td.ticket_events(spark, d)))


@query("blocker_tickets", sql=with_views(f"""
SELECT ticket_id, meeting_id, title, status FROM t
WHERE regexp_matches(content, '{td.ORDER_BLOCKER_PATTERN}')""", t=TICKETS))
def q_blocker_tickets(spark, d):
    from agendum.functions.expressions import mentions_blocker
    t = td.tickets(spark, d)
    return (t.filter(mentions_blocker("content", td.ORDER_BLOCKER_PATTERN) == 1)
             .select("ticket_id", "meeting_id", "title", "status"))
