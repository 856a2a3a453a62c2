"""Queries over model-answer documents and ML topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from agendum.operators import analysis as A
from agendum.operators import topics as TP
from agendum.plans.registry import query
from agendum.plans.sqlviews import (GROUP_MEMBERS, MEETINGS, ORDERED_TRANSCRIPTS, TICKETS, USERS,
                                    case, with_views)
from agendum.sources import testdata as td

_LINE_ORDER = ", ".join(td.HISTORY_TIEBREAK)
_VALID = f"""
, j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderpriority <> '{td.MALFORMED_PRIORITY}')
, new AS (SELECT o_orderkey AS doc_id, o_custkey AS meeting_id, 'Part ' || CAST(l_partkey AS VARCHAR) AS title,
                 'qty ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS content,
                 CASE WHEN l_returnflag = 'N' THEN NULL ELSE {case('l_returnflag', td.RETURNFLAG_STATUS)} END AS status,
                 l_suppkey AS assignee_id, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY {_LINE_ORDER}) - 1 AS INTEGER) AS item_no
          FROM j WHERE l_linestatus = 'O')
, upd AS (SELECT o_orderkey AS doc_id, o_custkey AS meeting_id,
                 CASE WHEN l_returnflag = 'N' THEN CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)
                      ELSE CAST(l_orderkey AS VARCHAR) END AS ticket_id,
                 {case('l_returnflag', td.RETURNFLAG_STATUS)} AS status,
                 CASE WHEN l_tax >= 0.04 THEN l_suppkey END AS assignee_id,
                 'line ' || CAST(l_linenumber AS VARCHAR) AS reason,
                 CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY {_LINE_ORDER}) - 1 AS INTEGER) AS item_no
          FROM j WHERE l_linestatus = 'F')
"""


def decoded(spark, d):
    return A.decode_analysis(td.analysis_documents(spark, d))


@query("analysis_new_tickets", sql=with_views(_VALID + "SELECT * FROM new", x="SELECT 1"))
def q_analysis_new_tickets(spark, d):
    items = decoded(spark, d)["items"].filter("kind = 'new'")
    return items.select("doc_id", "meeting_id", "title", "content", "status", "assignee_id", "item_no")


@query("analysis_rejects", sql=f"""
SELECT DISTINCT o_orderkey AS doc_id, o_custkey AS meeting_id, 'malformed' AS reject_reason
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '{td.MALFORMED_PRIORITY}'""")
def q_analysis_rejects(spark, d):
    return decoded(spark, d)["rejects"]


@query("meeting_metrics_from_analysis", sql=with_views(_VALID + """
, per_doc AS (SELECT o_orderkey, o_custkey, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS a,
                     count(*) AS s, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS b
              FROM j GROUP BY o_orderkey, o_custkey)
SELECT o_custkey AS meeting_id, CAST(sum(a) AS BIGINT) AS actionable_items_count,
       CAST(sum(s) AS BIGINT) AS status_updates_count, CAST(sum(b) AS BIGINT) AS blockers_mentioned,
       count(*) AS n_analyses
FROM per_doc GROUP BY o_custkey""", x="SELECT 1"))
def q_meeting_metrics_from_analysis(spark, d):
    return A.meeting_metrics_from_analysis(decoded(spark, d)["meeting_metrics"])


def _member_ok(alias: str) -> str:
    return (f"({alias}.assignee_id IS NULL OR EXISTS (SELECT 1 FROM m JOIN gm ON gm.group_id = m.group_id "
            f"WHERE m.meeting_id = {alias}.meeting_id AND gm.user_id = {alias}.assignee_id))")


_EVENTS = _VALID + f"""
, ev AS (
SELECT 'created' AS event_type, doc_id, item_no,
       sha256(CAST(meeting_id AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR) || '|' || CAST(item_no AS VARCHAR) || '|'
              || coalesce(title, '') || '|' || coalesce(content, '')) AS ticket_id,
       meeting_id, title, content, coalesce(nullif(status, ''), 'TODO') AS status, assignee_id, CAST(NULL AS VARCHAR) AS reason,
       CASE WHEN {_member_ok('new')} THEN NULL ELSE 'assignee_not_member' END AS reject_reason
FROM new
UNION ALL
SELECT 'updated', doc_id, item_no, ticket_id, meeting_id, NULL, NULL, status, assignee_id, reason,
       CASE WHEN NOT EXISTS (SELECT 1 FROM t WHERE t.ticket_id = upd.ticket_id) THEN 'unknown_ticket'
            WHEN NOT coalesce(status IN ('IN_PROGRESS', 'DONE'), false) THEN 'bad_status'
            WHEN NOT {_member_ok('upd')} THEN 'assignee_not_member' END
FROM upd)
"""


def events_df(spark, d):
    return A.apply_analysis(td.tickets(spark, d), decoded(spark, d)["items"], td.meetings(spark, d), td.group_members(spark, d))


@query("apply_ticket_updates", sql=with_views(_EVENTS + "SELECT * FROM ev", t=TICKETS, m=MEETINGS, gm=GROUP_MEMBERS))
def q_apply_ticket_updates(spark, d):
    return events_df(spark, d)


@query("tickets_after_analysis", sql=with_views(_EVENTS + """
, u AS (SELECT ticket_id, arg_max(status, (doc_id, item_no)) AS status,
               arg_max(assignee_id, (doc_id, item_no)) FILTER (assignee_id IS NOT NULL) AS assignee_id
        FROM ev WHERE event_type = 'updated' AND reject_reason IS NULL GROUP BY ticket_id)
SELECT t.ticket_id, t.meeting_id, t.title, t.content, coalesce(u.status, t.status) AS status,
       coalesce(u.assignee_id, t.assignee_id) AS assignee_id FROM t LEFT JOIN u ON u.ticket_id = t.ticket_id
UNION ALL
SELECT ticket_id, meeting_id, title, content, status, assignee_id FROM ev
WHERE event_type = 'created' AND reject_reason IS NULL""", t=TICKETS, m=MEETINGS, gm=GROUP_MEMBERS))
def q_tickets_after_analysis(spark, d):
    return A.tickets_after_analysis(td.tickets(spark, d), events_df(spark, d))


@query("analysis_context", sql=with_views("""
, s AS (SELECT * FROM ot WHERE text IS NOT NULL AND text <> '')
, l AS (SELECT *, lag(text) OVER (PARTITION BY meeting_id ORDER BY seq) AS prev FROM s)
, st AS (SELECT meeting_id, seq // 1000 AS piece, string_agg(text, chr(10) ORDER BY seq) AS transcript
         FROM l WHERE prev IS DISTINCT FROM text GROUP BY ALL)
, mt AS (SELECT DISTINCT meeting_id FROM ot)
, g AS (SELECT DISTINCT mt.meeting_id, m.group_id FROM mt JOIN m ON m.meeting_id = mt.meeting_id)
SELECT 'meeting' AS scope, meeting_id AS scope_id, '1_transcript' AS section, CAST(piece AS VARCHAR) AS item, transcript AS line FROM st
UNION ALL
SELECT 'meeting', meeting_id, '2_group', CAST(group_id AS VARCHAR), CAST(group_id AS VARCHAR) FROM g
UNION ALL
SELECT 'group', gm.group_id, '2_members', CAST(gm.user_id AS VARCHAR),
       '- ' || coalesce(nullif(u.name, ''), 'Unknown') || ' (ID: ' || CAST(gm.user_id AS VARCHAR) || ')'
FROM gm LEFT JOIN u ON u.user_id = gm.user_id WHERE gm.group_id IN (SELECT group_id FROM g)
UNION ALL
SELECT 'meeting', meeting_id, '3_tickets', ticket_id,
       '- [' || status || '] ' || title || ' (ID: ' || ticket_id || ', Assignee: ' || coalesce(nullif(u.name, ''), 'Unassigned') || ')'
FROM t LEFT JOIN u ON u.user_id = t.assignee_id WHERE meeting_id IN (SELECT meeting_id FROM mt)
UNION ALL
SELECT 'meeting', meeting_id, '3_tickets', '', 'No existing tickets.' FROM mt
WHERE meeting_id NOT IN (SELECT meeting_id FROM t)""",
    ot=ORDERED_TRANSCRIPTS, m=MEETINGS, gm=GROUP_MEMBERS, u=USERS, t=TICKETS))
def q_analysis_context(spark, d):
    return A.analysis_context(td.ordered_transcripts(spark, d), td.tickets(spark, d),
                              td.group_members(spark, d), td.users(spark, d), td.meetings(spark, d))


TOPICS_K = 5


@query("keyword_features")
def q_keyword_features(spark, d):
    seg = td.ordered_transcripts(spark, d).select("meeting_id", "seq", "text")
    model = TP.fit_keywords(seg)
    arr = F.unwrap_udt("tfidf_vec")["values"]     # the sparse vector's non-zero entries only
    return (TP.keyword_features(model, seg)
            .select("meeting_id", "seq", F.size(F.filter(arr, lambda x: x > 0)).alias("n_terms"),
                    F.round(F.array_max(arr), 6).alias("max_weight")))


@query("topic_clusters")
def q_topic_clusters(spark, d):
    seg = td.ordered_transcripts(spark, d).select("meeting_id", "seq", "text")
    return TP.cluster_topics(seg, k=TOPICS_K).select("meeting_id", "seq", "topic")
