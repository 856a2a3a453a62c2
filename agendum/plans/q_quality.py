"""Data-quality queries (Q1-Q3) over the logical tables."""

from __future__ import annotations

from agendum.functions.expressions import ROLES, TICKET_STATUSES
from agendum.operators import quality as Q
from agendum.plans.registry import query
from agendum.plans.sqlviews import (GROUP_MEMBERS, MEETINGS, TICKET_EVENTS, TICKET_HISTORY, MEMBERSHIP_CHANGES, TICKET_PATCHES,
                                    TICKETS, USERS, with_views)
from agendum.sources import testdata as td

_ST = ", ".join(f"'{s}'" for s in TICKET_STATUSES)
_RO = ", ".join(f"'{r}'" for r in ROLES)


@query("check_unique", sql=with_views("""
SELECT 'tickets.ticket_id' AS "check", ticket_id AS key, count(*) AS n FROM t GROUP BY ticket_id HAVING count(*) > 1
UNION ALL
SELECT 'group_members.group_user', CAST(group_id AS VARCHAR) || '|' || CAST(user_id AS VARCHAR), count(*)
FROM gm GROUP BY group_id, user_id HAVING count(*) > 1
UNION ALL
SELECT 'users.email', email, count(*) FROM u GROUP BY email HAVING count(*) > 1
UNION ALL
SELECT 'ticket_history.ticket_history_id', ticket_id || '|' || CAST(history_id AS VARCHAR), count(*)
FROM h GROUP BY ticket_id, history_id HAVING count(*) > 1""", t=TICKETS, gm=GROUP_MEMBERS, u=USERS, h=TICKET_HISTORY))
def q_check_unique(spark, d):
    return Q.check_unique({
        "tickets.ticket_id": (td.tickets(spark, d), ["ticket_id"]),
        "group_members.group_user": (td.group_members(spark, d), ["group_id", "user_id"]),
        "users.email": (td.users(spark, d), ["email"]),
        "ticket_history.ticket_history_id": (td.ticket_history(spark, d), ["ticket_id", "history_id"]),
    })


@query("check_orphans", sql=with_views("""
SELECT 'tickets.meeting_id' AS "check",
       (SELECT count(*) FROM t WHERE meeting_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM m WHERE m.meeting_id = t.meeting_id)) AS orphan_rows
UNION ALL SELECT 'ticket_history.ticket_id',
       (SELECT count(*) FROM h WHERE ticket_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM t WHERE t.ticket_id = h.ticket_id))
UNION ALL SELECT 'group_members.user_id',
       (SELECT count(*) FROM gm WHERE user_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = gm.user_id))
UNION ALL SELECT 'tickets.assignee_id',
       (SELECT count(*) FROM t WHERE assignee_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = t.assignee_id))
UNION ALL SELECT 'ticket_events.meeting_id',
       (SELECT count(*) FROM te WHERE meeting_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM m WHERE m.meeting_id = te.meeting_id))
UNION ALL SELECT 'membership_changes.requester_id',
       (SELECT count(*) FROM mc WHERE requester_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = mc.requester_id))
UNION ALL SELECT 'ticket_patches.assignee_id',
       (SELECT count(*) FROM pa WHERE assignee_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM gm WHERE gm.user_id = pa.assignee_id AND gm.role = 'ADMIN'))""", mc=MEMBERSHIP_CHANGES, pa=TICKET_PATCHES,
    t=TICKETS, m=MEETINGS, h=TICKET_HISTORY, gm=GROUP_MEMBERS, u=USERS, te=TICKET_EVENTS))
def q_check_orphans(spark, d):
    t, m, u = td.tickets(spark, d), td.meetings(spark, d), td.users(spark, d)
    return Q.check_orphans({
        "tickets.meeting_id": (t, m, ["meeting_id"]),
        "ticket_history.ticket_id": (td.ticket_history(spark, d), t, ["ticket_id"]),
        "group_members.user_id": (td.group_members(spark, d), u, ["user_id"]),
        "tickets.assignee_id": (t, u.withColumnRenamed("user_id", "assignee_id"), ["assignee_id"]),
        "ticket_events.meeting_id": (td.ticket_events(spark, d), m, ["meeting_id"]),
        "membership_changes.requester_id": (td.membership_changes(spark, d), u.withColumnRenamed("user_id", "requester_id"), ["requester_id"]),
        "ticket_patches.assignee_id": (td.ticket_patches(spark, d), td.group_members(spark, d).filter("role = 'ADMIN'")
                                       .withColumnRenamed("user_id", "assignee_id"), ["assignee_id"]),
    })


@query("check_domain", sql=with_views(f"""
SELECT 'tickets.status' AS "check",
       CAST(coalesce(sum(CASE WHEN coalesce(status IN ({_ST}), false) THEN 0 ELSE 1 END), 0) AS BIGINT) AS violations
FROM t
UNION ALL SELECT 'ticket_events.status',
       CAST(coalesce(sum(CASE WHEN coalesce(status IN ({_ST}), false) THEN 0 ELSE 1 END), 0) AS BIGINT) FROM te
UNION ALL SELECT 'ticket_history.new_status',
       CAST(coalesce(sum(CASE WHEN coalesce(new_status IN ({_ST}), false) THEN 0 ELSE 1 END), 0) AS BIGINT) FROM h
UNION ALL SELECT 'group_members.role',
       CAST(coalesce(sum(CASE WHEN coalesce(role IN ({_RO}), false) THEN 0 ELSE 1 END), 0) AS BIGINT) FROM gm
UNION ALL SELECT 'membership_changes.new_role',
       CAST(coalesce(sum(CASE WHEN coalesce(new_role IN ({_RO}), false) THEN 0 ELSE 1 END), 0) AS BIGINT) FROM mc""", mc=MEMBERSHIP_CHANGES,
    t=TICKETS, te=TICKET_EVENTS, h=TICKET_HISTORY, gm=GROUP_MEMBERS))
def q_check_domain(spark, d):
    return Q.check_domain({
        "tickets.status": (td.tickets(spark, d), "status", TICKET_STATUSES, True),
        "ticket_events.status": (td.ticket_events(spark, d), "status", TICKET_STATUSES, True),
        "ticket_history.new_status": (td.ticket_history(spark, d), "new_status", TICKET_STATUSES, True),
        "group_members.role": (td.group_members(spark, d), "role", ROLES, True),
        "membership_changes.new_role": (td.membership_changes(spark, d), "new_role", ROLES, True),
    })
