"""Batch forms of the stream operators (Z6, Z7, Z8, J9, S3). The streaming
forms of the same functions are checked against these in tests/."""

from __future__ import annotations

from pyspark.sql import functions as F

from agendum.operators.trends import group_trends
from agendum.plans.q_metrics import DAY, HOUR, realtime_scores, ticket_metrics_df, ticket_metrics_sql
from agendum.plans.registry import query
from agendum.plans.sqlviews import MEETINGS, TICKET_EVENTS, TIMED_TRANSCRIPTS, with_views
from agendum.sinks.writers import route_metrics
from agendum.sources import events as EV
from agendum.sources import testdata as td
from agendum.streaming import operators as Z

SAVE_WINDOW = "30 seconds"
SESSION_GAP = "6 hours"
REQUEST_BOUND, REQUEST_BOUND_SEC = "6 hours", 6 * 3600
RUN_TIMEOUT = "1 hour"
REQUEST_TYPE, ARRIVAL_TYPE = "error", "view"     # event types standing for request / transcript arrival


def partial_segments(spark, d):
    """Timed transcript segments; a 'purchase' event stands for the final marker."""
    e = td.table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("meeting_id"), "ts",
                    F.col("event_type").alias("text"), (F.col("event_type") != "purchase").alias("is_partial"))


@query("save_windows", sql=f"""
SELECT time_bucket(INTERVAL '{SAVE_WINDOW}', ts) AS window_start,
       time_bucket(INTERVAL '{SAVE_WINDOW}', ts) + INTERVAL '{SAVE_WINDOW}' AS window_end,
       user_id AS meeting_id, count(*) AS n_segments,
       coalesce(string_agg(event_type, ' ' ORDER BY ts, event_id)
                  FILTER (WHERE event_type IS NOT NULL AND event_type <> ''), '') AS text,
       max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 AS is_final
FROM events GROUP BY ALL""")
def q_save_windows(spark, d):
    return Z.save_windows(partial_segments(spark, d), SAVE_WINDOW)


@query("meeting_sessions", sql=with_views(f"""
, l AS (SELECT meeting_id, ts, seq, lag(ts) OVER (PARTITION BY meeting_id ORDER BY ts, seq) AS prev FROM tt)
, f AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL '{SESSION_GAP}' THEN 1 ELSE 0 END)
                    OVER (PARTITION BY meeting_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS sess FROM l)
SELECT meeting_id, min(ts) AS session_start, max(ts) + INTERVAL '{SESSION_GAP}' AS session_end,
       count(*) AS n_events
FROM f GROUP BY meeting_id, sess""", tt=TIMED_TRANSCRIPTS))
def q_meeting_sessions(spark, d):
    return Z.meeting_sessions(td.timed_transcripts(spark, d), SESSION_GAP)


@query("await_transcript_timeout", sql=f"""
WITH r AS (SELECT event_id AS request_id, user_id AS meeting_id, ts AS requested_at
           FROM events WHERE event_type = '{REQUEST_TYPE}')
, t AS (SELECT user_id AS meeting_id, ts FROM events WHERE event_type = '{ARRIVAL_TYPE}')
SELECT r.request_id, r.meeting_id, r.requested_at, min(t.ts) AS first_transcript_at,
       min(t.ts) IS NULL AS timed_out
FROM r LEFT JOIN t ON t.meeting_id = r.meeting_id
                  AND t.ts BETWEEN r.requested_at AND r.requested_at + INTERVAL '{REQUEST_BOUND}'
GROUP BY r.request_id, r.meeting_id, r.requested_at""")
def q_await_transcript_timeout(spark, d):
    e = td.table(spark, d, "events").select("event_id", F.col("user_id").alias("meeting_id"), "ts", "event_type")
    req = e.filter(F.col("event_type") == REQUEST_TYPE).select(F.col("event_id").alias("request_id"),
                                                              "meeting_id", "ts")
    arr = e.filter(F.col("event_type") == ARRIVAL_TYPE).select("meeting_id", "ts")
    return Z.await_transcripts(req, arr, REQUEST_BOUND, REQUEST_BOUND_SEC)


def valid_segments(spark, d):
    """Valid segments and the final markers of the wire."""
    valid, _, markers = EV.decode_transcripts(td.transcript_messages(spark, d))
    return valid.unionByName(markers).select("meeting_id", "audio_id", "group_id", F.col("offset").alias("seq"), "text",
                                             "is_partial", F.col("event_ts").cast("timestamp_ntz").alias("ts"))


@query("meeting_state", sql=f"""
WITH v AS (SELECT event_id AS seq, CASE WHEN event_type = '{td.TIMED_EVENT_TYPE}' THEN date_trunc('milliseconds', ts - INTERVAL '1 minute') ELSE ts END AS ts,
                  user_id AS meeting_id, event_id AS audio_id,
                  CAST(json_extract_string(props, '$.k') AS BIGINT) AS group_id, event_type AS text, true AS is_partial
           FROM events
           WHERE event_type NOT IN ('{td.MALFORMED_EVENT_TYPE}', '{td.MARKER_EVENT_TYPE}') AND user_id <> 0 AND event_id <> 0
             AND coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) <> 0
           UNION ALL
           SELECT event_id, ts, user_id, NULL, NULL, '', false FROM events
           WHERE event_type = '{td.MARKER_EVENT_TYPE}' AND user_id <> 0)
, l AS (SELECT *, NOT coalesce(is_partial, false) AS fin, lag(ts) OVER w AS pts,
               lag(NOT coalesce(is_partial, false)) OVER w AS pfin
        FROM v WINDOW w AS (PARTITION BY meeting_id ORDER BY ts, seq))
, s AS (SELECT *, sum(CASE WHEN pts IS NULL OR pfin OR ts > pts + INTERVAL '{RUN_TIMEOUT}' THEN 1 ELSE 0 END)
                    OVER (PARTITION BY meeting_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT meeting_id, CAST(run AS BIGINT) AS run, min(audio_id) AS audio_id, min(group_id) AS group_id,
       CAST(sum(CASE WHEN fin THEN 0 ELSE 1 END) AS BIGINT) AS n_partials,
       CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, min(ts) AS first_ts, max(ts) AS last_ts,
       bool_or(fin) AS ended
FROM s GROUP BY meeting_id, run""")
def q_meeting_state(spark, d):
    return Z.meeting_runs(valid_segments(spark, d), RUN_TIMEOUT)


def _route_sql() -> str:
    tm = ticket_metrics_sql(DAY)
    return with_views(f"""
, tm AS ({tm})
, rt AS (SELECT meeting_id FROM seg JOIN tck USING (ws, meeting_id))
, tr_rt AS ({_trend_keys()})
SELECT 'analytics.ticket.metrics' AS topic, CAST(meeting_id AS VARCHAR) AS key, 'ticket_metrics' AS msg_type,
       6 AS n_fields, meeting_id FROM tm
UNION ALL SELECT 'analytics.productivity', CAST(meeting_id AS VARCHAR), 'productivity', 8, meeting_id FROM rt
UNION ALL SELECT 'analytics.trends.groups', CAST(NULL AS VARCHAR), 'trends', 8, CAST(NULL AS BIGINT) FROM tr_rt""",
        te=TICKET_EVENTS, tt=TIMED_TRANSCRIPTS, seg=_SEG_DAY, tck=_TCK_DAY)


def _trend_keys() -> str:
    b = "time_bucket(INTERVAL '1 hour', ts)"
    return f"""SELECT DISTINCT m.group_id, time_bucket(INTERVAL '7 days', s.ws) AS period_start
        FROM (SELECT {b} AS ws, meeting_id FROM tt GROUP BY ALL) s
        JOIN (SELECT {b} AS ws, meeting_id FROM te GROUP BY ALL) k USING (ws, meeting_id)
        JOIN ({MEETINGS}) m USING (meeting_id)"""


_SEG_DAY = "SELECT time_bucket(INTERVAL '1 day', ts) AS ws, meeting_id FROM tt GROUP BY ALL"
_TCK_DAY = "SELECT time_bucket(INTERVAL '1 day', ts) AS ws, meeting_id FROM te GROUP BY ALL"


@query("route_metrics_envelope", sql=_route_sql())
def q_route_metrics_envelope(spark, d):
    """S3: the routed (topic, key, value) rows, checked through what a
    consumer reads back: topic, key, message type and the data fields."""
    frames = {
        "ticket_metrics": ticket_metrics_df(spark, d, DAY),
        "productivity": realtime_scores(spark, d, DAY),
        "trends": group_trends(realtime_scores(spark, d, HOUR), ticket_metrics_df(spark, d, HOUR),
                               td.meetings(spark, d), "week").withColumnRenamed("period_start", "window_start"),
    }
    routed = route_metrics(frames, key="meeting_id")
    return routed.select("topic", "key", F.get_json_object("value", "$.type").alias("msg_type"),
                         F.size(F.json_object_keys(F.get_json_object("value", "$.data"))).alias("n_fields"),
                         F.get_json_object("value", "$.data.meeting_id").cast("long").alias("meeting_id"))
