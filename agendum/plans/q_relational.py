"""Queries over relational reads, joins, table changes and decoding
(P4, P10, J2-J8, L3, U1-U7, S7, F9, F13, Z4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from agendum.functions.expressions import ROLES, preview
from agendum.operators import membership as MB
from agendum.operators import metrics as M
from agendum.operators import relational as R
from agendum.plans.common import rounded
from agendum.plans.q_metrics import DAY, realtime_scores, score_cte
from agendum.plans.registry import query
from agendum.plans.sqlviews import (GROUP_MEMBERS, GROUPS, MEETINGS, MEMBERSHIP_CHANGES,
                                    ORDERED_TRANSCRIPTS, TICKET_HISTORY, TICKET_PATCHES,
                                    TICKET_SUGGESTIONS, TICKETS, TIMED_TRANSCRIPTS, USERS,
                                    with_views)
from agendum.session import checkpoint_dir
from agendum.sinks.bucketed import BucketedTable
from agendum.sources import events as EV
from agendum.sources import testdata as td

RECENT_K = 10
PREVIEW_CHARS = 50
TIEBREAK_ASC = ", ".join(td.HISTORY_TIEBREAK)
TIEBREAK_DESC = ", ".join(f"{c} DESC" for c in td.HISTORY_TIEBREAK)


@query("list_meetings", sql=with_views(
    "SELECT meeting_id, min(ts) AS created_at FROM tt GROUP BY meeting_id", tt=TIMED_TRANSCRIPTS))
def q_list_meetings(spark, d):
    s = M.meeting_summary(td.timed_transcripts(spark, d)).select(
        "meeting_id", F.col("started_at").alias("created_at"))
    return R.list_meetings(s)


@query("recent_meetings", sql=with_views(f"""
SELECT meeting_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS segment_count
FROM tt GROUP BY meeting_id ORDER BY started_at DESC, meeting_id LIMIT {RECENT_K}""", tt=TIMED_TRANSCRIPTS))
def q_recent_meetings(spark, d):
    s = M.meeting_summary(td.timed_transcripts(spark, d)).select(
        "meeting_id", "started_at", "ended_at", "segment_count")
    return R.recent(s, "started_at", RECENT_K, ["meeting_id"])


@query("metrics_with_group", sql=score_cte(DAY) + f"""
, m AS ({MEETINGS})
SELECT window_start, window_end, meeting_id, group_id, round(productivity_score, 6) AS productivity_score,
       ticket_count, actionable_tickets
FROM rt JOIN m USING (meeting_id)""")
def q_metrics_with_group(spark, d):
    rt = realtime_scores(spark, d).select("window_start", "window_end", "meeting_id", "productivity_score",
                                          "ticket_count", "actionable_tickets")
    return rounded(M.with_group(rt, td.meetings(spark, d)))


@query("tickets_with_assignee", sql=with_views("""
SELECT ticket_id, meeting_id, title, status, assignee_id, u.name AS assignee_name
FROM t LEFT JOIN u ON u.user_id = t.assignee_id""", t=TICKETS, u=USERS))
def q_tickets_with_assignee(spark, d):
    t = td.tickets(spark, d).select("ticket_id", "meeting_id", "title", "status", "assignee_id")
    return R.tickets_with_assignee(t, td.users(spark, d))


@query("user_groups_semi", sql=with_views("""
SELECT group_id, name FROM g
WHERE group_id IN (SELECT group_id FROM gm WHERE user_id IN (SELECT assignee_id FROM t))""",
    g=GROUPS, gm=GROUP_MEMBERS, t=TICKETS))
def q_user_groups_semi(spark, d):
    assignees = td.tickets(spark, d).select(F.col("assignee_id").alias("user_id"))
    return R.user_groups(td.groups(spark, d), td.group_members(spark, d), assignees)


@query("groups_with_members", sql=with_views("""
SELECT g.group_id, g.name AS group_name, coalesce(c.member_count, 0) AS member_count,
       gm.user_id, u.name AS user_name, gm.role
FROM g LEFT JOIN (SELECT group_id, count(*) AS member_count FROM gm GROUP BY group_id) c ON c.group_id = g.group_id
LEFT JOIN gm ON gm.group_id = g.group_id LEFT JOIN u ON u.user_id = gm.user_id""",
    g=GROUPS, gm=GROUP_MEMBERS, u=USERS))
def q_groups_with_members(spark, d):
    return R.groups_with_members(td.groups(spark, d), td.group_members(spark, d), td.users(spark, d))


@query("group_member_names", sql=with_views("""
SELECT gm.group_id, gm.user_id, coalesce(nullif(u.name, ''), 'Unknown') AS name
FROM gm LEFT JOIN u ON u.user_id = gm.user_id""", gm=GROUP_MEMBERS, u=USERS))
def q_group_member_names(spark, d):
    return R.group_member_names(td.group_members(spark, d), td.users(spark, d))


@query("authorized_changes", sql=with_views("""
SELECT change_id, group_id, requester_id, action,
       EXISTS (SELECT 1 FROM gm WHERE gm.group_id = c.group_id AND gm.user_id = c.requester_id
               AND gm.role = 'ADMIN') AS authorized
FROM c""", c=MEMBERSHIP_CHANGES, gm=GROUP_MEMBERS))
def q_authorized_changes(spark, d):
    ch = td.membership_changes(spark, d).select("change_id", "group_id", "requester_id", "action")
    ok, denied = R.authorized_changes(ch, td.group_members(spark, d))
    return ok.withColumn("authorized", F.lit(True)).unionByName(denied.withColumn("authorized", F.lit(False)))


_ROLES_SQL = ", ".join(f"'{r}'" for r in ROLES)
_JUDGED_SQL = f"""
, adm AS (SELECT group_id, user_id AS requester_id FROM gm WHERE role = 'ADMIN')
, j AS (SELECT c.*, (a.requester_id IS NOT NULL) AS authorized, u.user_id AS target_user_id,
               cur.role AS current_role
        FROM c LEFT JOIN adm a ON a.group_id = c.group_id AND a.requester_id = c.requester_id
        LEFT JOIN u ON u.email = c.email
        LEFT JOIN gm cur ON cur.group_id = c.group_id AND cur.user_id = u.user_id)
, judged AS (SELECT *, CASE WHEN action = 'create' THEN NULL
                            WHEN NOT authorized THEN 'not_admin'
                            WHEN target_user_id IS NULL THEN 'unknown_email'
                            WHEN action = 'invite' AND current_role IS NOT NULL THEN 'already_member'
                            WHEN action IN ('role', 'remove') AND current_role IS NULL THEN 'not_member'
                            WHEN action = 'role' AND new_role NOT IN ({_ROLES_SQL}) THEN 'bad_role'
                            WHEN action NOT IN ('create', 'invite', 'role', 'remove') THEN 'bad_action'
                       END AS reject_reason FROM j)
, ops AS (SELECT CASE WHEN action = 'create' THEN -change_id - 1 ELSE group_id END AS group_id,
                 CASE WHEN action = 'create' THEN requester_id ELSE target_user_id END AS user_id, change_id,
                 CASE action WHEN 'create' THEN 'ADMIN' WHEN 'invite' THEN 'MEMBER' WHEN 'role' THEN new_role END
                   AS op_role,
                 action = 'remove' AS is_delete
          FROM judged WHERE reject_reason IS NULL)
"""


def _membership_args(spark, d):
    return td.group_members(spark, d), td.users(spark, d), td.membership_changes(spark, d)


@query("apply_membership", sql=with_views(_JUDGED_SQL + """
, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, user_id ORDER BY change_id DESC) AS rn
                          FROM ops) WHERE rn = 1)
SELECT coalesce(gm.group_id, last.group_id) AS group_id, coalesce(gm.user_id, last.user_id) AS user_id,
       coalesce(last.op_role, gm.role) AS role
FROM gm FULL OUTER JOIN last ON gm.group_id = last.group_id AND gm.user_id = last.user_id
WHERE NOT coalesce(last.is_delete, false)""", c=MEMBERSHIP_CHANGES, gm=GROUP_MEMBERS, u=USERS))
def q_apply_membership(spark, d):
    return MB.apply_membership(*_membership_args(spark, d))


@query("membership_rejects", sql=with_views(_JUDGED_SQL + """
SELECT change_id, action, group_id, requester_id, reject_reason FROM judged WHERE reject_reason IS NOT NULL""",
    c=MEMBERSHIP_CHANGES, gm=GROUP_MEMBERS, u=USERS))
def q_membership_rejects(spark, d):
    return MB.membership_rejects(*_membership_args(spark, d))


@query("remove_members", sql=with_views(_JUDGED_SQL + """
SELECT group_id, user_id, role FROM gm
WHERE NOT EXISTS (SELECT 1 FROM ops WHERE ops.is_delete AND ops.group_id = gm.group_id AND ops.user_id = gm.user_id)""",
    c=MEMBERSHIP_CHANGES, gm=GROUP_MEMBERS, u=USERS))
def q_remove_members(spark, d):
    return MB.remove_members(*_membership_args(spark, d))


@query("validate_rows", sql=with_views(f"""
SELECT change_id, name, email, new_role AS role,
       CASE WHEN coalesce(trim(name), '') = '' THEN 'blank_name'
            WHEN coalesce(instr(email, '@'), 0) = 0 THEN 'bad_email'
            WHEN NOT coalesce(new_role IN ({_ROLES_SQL}), false) THEN 'bad_role' END AS reject_reason,
       CASE WHEN coalesce(trim(name), '') = '' OR coalesce(instr(email, '@'), 0) = 0
                 OR NOT coalesce(new_role IN ({_ROLES_SQL}), false) THEN false ELSE true END AS is_valid
FROM c""", c=MEMBERSHIP_CHANGES))
def q_validate_rows(spark, d):
    ch = td.membership_changes(spark, d).select("change_id", "name", "email", F.col("new_role").alias("role"))
    return R.validate_rows(ch)


_LATEST_HISTORY_SQL = f"""
, c AS (SELECT ticket_id, new_status AS status, changed_at AS updated_at FROM
        (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY changed_at DESC, {TIEBREAK_DESC}) AS rn FROM h)
        WHERE rn = 1)
"""


_UPSERT_SQL = with_views(_LATEST_HISTORY_SQL + """
SELECT coalesce(t.ticket_id, c.ticket_id) AS ticket_id, t.meeting_id, t.title, t.content,
       coalesce(c.status, t.status) AS status, t.assignee_id, t.created_at,
       coalesce(c.updated_at, t.updated_at) AS updated_at
FROM t FULL OUTER JOIN c ON t.ticket_id = c.ticket_id""", h=TICKET_HISTORY, t=TICKETS)


def _latest_status(spark, d):
    h = td.ticket_history(spark, d).select("ticket_id", "changed_at", *td.HISTORY_TIEBREAK, "new_status")
    return R.latest_by_key(h, ["ticket_id"], ["changed_at", *td.HISTORY_TIEBREAK]).select(
        "ticket_id", F.col("new_status").alias("status"), F.col("changed_at").alias("updated_at"))


@query("upsert_snapshot", sql=_UPSERT_SQL)
def q_upsert_snapshot(spark, d):
    return R.upsert(td.tickets(spark, d), _latest_status(spark, d), ["ticket_id"], ["status", "updated_at"])


@query("upsert_bucketed", sql=_UPSERT_SQL)
def q_upsert_bucketed(spark, d):
    run = uuid.uuid4().hex
    table = BucketedTable(spark, f"tickets_{run}", f"{checkpoint_dir(spark)}/agendum/tickets-{run}", ["ticket_id"], 8)
    table.create(td.tickets(spark, d))
    return table.upsert(_latest_status(spark, d), ["status", "updated_at"], 1)


_PATCH_SQL = f"""
, po AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY patched_at, {TIEBREAK_ASC}) AS rn FROM pa)
, p AS (SELECT ticket_id, arg_max(title, rn) FILTER (title <> '') AS title,
               arg_max(content, rn) FILTER (content <> '') AS content,
               arg_max(status, rn) FILTER (status <> '') AS status,
               max(rn) FILTER (has_assignee_id) AS assignee_rn, count(*) FILTER (status <> '') AS n
        FROM po GROUP BY ticket_id)
, patched AS (
  SELECT t.ticket_id, t.meeting_id, coalesce(p.title, t.title) AS title, coalesce(p.content, t.content) AS content,
         coalesce(p.status, t.status) AS status,
         CASE WHEN p.assignee_rn IS NOT NULL THEN a.assignee_id ELSE t.assignee_id END AS assignee_id,
         t.created_at, t.updated_at, coalesce(p.n, 0) AS status_updates
  FROM t LEFT JOIN p ON p.ticket_id = t.ticket_id LEFT JOIN po a ON a.ticket_id = p.ticket_id AND a.rn = p.assignee_rn)
"""


def patched_df(spark, d):
    return R.patch(td.tickets(spark, d), td.ticket_patches(spark, d), ["patched_at", *td.HISTORY_TIEBREAK])


@query("patch_tickets", sql=with_views(_PATCH_SQL + "SELECT * FROM patched", pa=TICKET_PATCHES, t=TICKETS))
def q_patch_tickets(spark, d):
    return patched_df(spark, d)


_NEW_SQL = """
, nt AS (SELECT sha256(CAST(meeting_id AS VARCHAR) || '|' || source_key) AS ticket_id, meeting_id, title, content,
                coalesce(status, 'TODO') AS status, assignee_id, created_at, created_at AS updated_at FROM s)
"""


def new_tickets_df(spark, d):
    return R.new_tickets(td.ticket_suggestions(spark, d), ["meeting_id", "source_key"])


@query("new_tickets", sql=with_views(_NEW_SQL + "SELECT * FROM nt", s=TICKET_SUGGESTIONS))
def q_new_tickets(spark, d):
    return new_tickets_df(spark, d)


@query("union_tickets", sql=with_views(_NEW_SQL + """
SELECT ticket_id, meeting_id, status, assignee_id, created_at AS event_at, 'new' AS kind FROM nt
UNION ALL
SELECT pa.ticket_id, t.meeting_id, pa.status, CASE WHEN has_assignee_id THEN pa.assignee_id END, patched_at, 'updated'
FROM pa JOIN t ON t.ticket_id = pa.ticket_id WHERE pa.status <> ''""", s=TICKET_SUGGESTIONS, pa=TICKET_PATCHES, t=TICKETS))
def q_union_tickets(spark, d):
    new = new_tickets_df(spark, d).select("ticket_id", "meeting_id", "status", "assignee_id",
                                          F.col("created_at").alias("event_at"), F.lit("new").alias("kind"))
    upd = R.patch_events(td.tickets(spark, d), td.ticket_patches(spark, d)).select(
        "ticket_id", "meeting_id", "status", F.when(F.col("has_assignee_id"), F.col("assignee_id")).alias("assignee_id"),
        F.col("patched_at").alias("event_at"), F.lit("updated").alias("kind"))
    return R.union_all(new, upd)


@query("distinct_meetings", sql=with_views(
    "SELECT meeting_id FROM tt UNION SELECT meeting_id FROM t", tt=TIMED_TRANSCRIPTS, t=TICKETS))
def q_distinct_meetings(spark, d):
    a = td.timed_transcripts(spark, d).select("meeting_id")
    b = td.tickets(spark, d).select("meeting_id")
    return a.unionByName(b).distinct()


_GROUP_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_HAS_IDS = f"user_id <> 0 AND event_id <> 0 AND coalesce({_GROUP_SQL}, 0) <> 0"
_EVENT_TS = f"CASE WHEN event_type = '{td.TIMED_EVENT_TYPE}' THEN date_trunc('milliseconds', ts - INTERVAL '1 minute') ELSE ts END"


@query("valid_messages", sql=f"""
SELECT event_id AS offset, ts AS timestamp, user_id AS meeting_id, event_id AS audio_id,
       {_GROUP_SQL} AS group_id, event_type AS text, true AS is_partial, {_EVENT_TS} AS event_ts
FROM events WHERE event_type NOT IN ('{td.MALFORMED_EVENT_TYPE}', '{td.MARKER_EVENT_TYPE}') AND {_HAS_IDS}""")
def q_valid_messages(spark, d):
    valid = EV.decode_transcripts(td.transcript_messages(spark, d))[0]
    return valid.withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))   # zone-free, as the events table


@query("rejected_messages", sql=f"""
SELECT event_id AS offset, CASE WHEN event_type = '{td.MALFORMED_EVENT_TYPE}' THEN 'malformed' ELSE 'missing_id' END AS reject_reason
FROM events WHERE event_type = '{td.MALFORMED_EVENT_TYPE}' OR CASE WHEN event_type = '{td.MARKER_EVENT_TYPE}' THEN user_id = 0 ELSE NOT ({_HAS_IDS}) END""")
def q_rejected_messages(spark, d):
    return EV.decode_transcripts(td.transcript_messages(spark, d))[1].select("offset", "reject_reason")


@query("final_markers", sql=f"""
SELECT event_id AS offset, user_id AS meeting_id, ts AS event_ts FROM events
WHERE event_type = '{td.MARKER_EVENT_TYPE}' AND user_id <> 0""")
def q_final_markers(spark, d):
    return EV.decode_transcripts(td.transcript_messages(spark, d))[2].select("offset", "meeting_id", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"))


@query("normalized_tickets", sql=with_views("""
SELECT ticket_id, meeting_id, title, status, CAST(NULL AS BIGINT) AS assignee_id, CAST(NULL AS VARCHAR) AS reason, created_at AS event_at FROM t
UNION ALL
SELECT h.ticket_id, t.meeting_id, NULL, h.new_status, h.l_suppkey, 'line ' || CAST(history_id AS VARCHAR), changed_at
FROM h LEFT JOIN t ON t.ticket_id = h.ticket_id WHERE h.new_status <> 'TODO'""", h=TICKET_HISTORY, t=TICKETS))
def q_normalized_tickets(spark, d):
    rows = EV.with_meeting(EV.normalize_ticket_events(td.ticket_messages(spark, d)), td.tickets(spark, d))
    return rows.select("ticket_id", "meeting_id", "title", "status", "assignee_id", "reason", F.col("timestamp").alias("event_at"))


@query("json_props", sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def q_json_props(spark, d):
    e = td.table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k BIGINT").alias("p")).select("event_id", "p.k")


@query("text_preview", sql=with_views(f"""
SELECT meeting_id, seq, substring(text, 1, {PREVIEW_CHARS}) AS preview FROM ot""", ot=ORDERED_TRANSCRIPTS))
def q_text_preview(spark, d):
    t = td.ordered_transcripts(spark, d)
    return t.select("meeting_id", "seq", preview("text", PREVIEW_CHARS).alias("preview"))


@query("dedup_events", sql="""
SELECT DISTINCT event_id, ts, user_id AS meeting_id, event_type
FROM (SELECT * FROM events UNION ALL SELECT * FROM events)""")
def q_dedup_events(spark, d):
    # Every event delivered twice (one copy per consumer group), then de-duplicated on its id.
    e = td.table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("meeting_id"), "event_type")
    return R.dedup(e.unionByName(e), ["event_id"])
