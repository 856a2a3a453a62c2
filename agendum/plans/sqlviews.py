"""The logical-table mappings of ``agendum.sources.testdata`` written as DuckDB
SQL, for the oracle side. Built from the same fixed-value dictionaries."""

from __future__ import annotations

from agendum.sources.testdata import (ADMIN_EVERY, EVENT_STATUS, ORDER_STATUS,
                                      RETURNFLAG_STATUS, SPOKEN)


def case(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE NULL END"


TICKET_EVENTS = f"""
SELECT event_id, CAST(event_id AS VARCHAR) AS ticket_id, user_id AS meeting_id, ts,
       event_type AS title, event_type AS content, {case('event_type', EVENT_STATUS)} AS status
FROM events"""

TIMED_TRANSCRIPTS = """
SELECT event_id AS seq, user_id AS meeting_id, ts, event_type AS text FROM events"""

TICKETS = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS ticket_id, o_custkey AS meeting_id,
       o_orderpriority AS title, o_orderpriority AS content,
       {case('o_orderstatus', ORDER_STATUS)} AS status,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_custkey END AS assignee_id,
       o_orderdate AS created_at, o_orderdate AS updated_at
FROM orders"""

TICKET_HISTORY = f"""
SELECT CAST(l_orderkey AS VARCHAR) AS ticket_id, CAST(l_linenumber AS BIGINT) AS history_id,
       l_shipdate AS changed_at, {case('l_returnflag', RETURNFLAG_STATUS)} AS new_status,
       l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
FROM lineitem"""

MEETING_AUDIOS = """
SELECT c_custkey AS meeting_id, CAST(c_nationkey AS BIGINT) AS group_id, unnest([c_custkey * 10, c_custkey * 10 + 1]) AS audio_id
FROM customer"""

# One row per meeting: what a join from meetings to groups may see.
MEETINGS = f"SELECT DISTINCT meeting_id, group_id FROM ({MEETING_AUDIOS})"

USERS = """
SELECT c_custkey AS user_id, c_name AS name,
       lower(replace(c_name, '#', '.')) || '@corp.test' AS email FROM customer"""

GROUPS = """
SELECT CAST(n_nationkey AS BIGINT) AS group_id, n_name AS name FROM nation"""

GROUP_MEMBERS = f"""
SELECT CAST(c_nationkey AS BIGINT) AS group_id, c_custkey AS user_id,
       CASE WHEN c_custkey % {ADMIN_EVERY} = 0 THEN 'ADMIN' ELSE 'MEMBER' END AS role
FROM customer"""

ORDERED_TRANSCRIPTS = """
SELECT conv_id AS meeting_id, conv_id * 10 + turn % 2 AS audio_id, turn AS seq,
       role AS speaker, text FROM conversations"""

_SAID = ", ".join("'" + x + "'" for x in SPOKEN)
SPOKEN_TRANSCRIPTS = f"""
SELECT conv_id AS meeting_id, turn AS seq,
       coalesce(text, '') || ' ' || replace(([{_SAID}])[turn % {len(SPOKEN)} + 1], '{{name}}', 'Customer#' || lpad(CAST(conv_id AS VARCHAR), 9, '0')) AS text
FROM conversations"""

AUDIO_CHUNKS = """
SELECT lang AS meeting_id, doc_id AS seq, n_chars AS n_bytes FROM documents"""

LATENCY = """
SELECT l_orderkey AS meeting_id, l_quantity AS kafka_delivery_ms,
       l_extendedprice AS processing_ms, l_discount AS total_ms FROM lineitem"""


def with_views(body: str, **views: str) -> str:
    """``WITH name AS (sql), ... body``."""
    ctes = ",\n".join(f"{k} AS ({v})" for k, v in views.items())
    return f"WITH {ctes}\n{body}"


def _membership_changes() -> str:
    from agendum.sources.testdata import (MEMBERSHIP_ACTIONS, OTHER_DOMAIN_SEGMENT,
                                          ROLE_BY_SEGMENT)
    acts = ", ".join(f"'{a}'" for a in MEMBERSHIP_ACTIONS)
    return f"""
SELECT c_custkey AS change_id, c_custkey - c_custkey % {ADMIN_EVERY} AS requester_id,
       CAST(c_nationkey AS BIGINT) AS group_id,
       ([{acts}])[c_custkey % {len(MEMBERSHIP_ACTIONS)} + 1] AS action, c_name AS name,
       CASE WHEN c_acctbal < 0 THEN c_name
            WHEN c_mktsegment = '{OTHER_DOMAIN_SEGMENT}' THEN lower(replace(c_name, '#', '.')) || '@other.test'
            ELSE lower(replace(c_name, '#', '.')) || '@corp.test' END AS email,
       coalesce({case('c_mktsegment', ROLE_BY_SEGMENT)}, 'MEMBER') AS new_role
FROM customer"""


MEMBERSHIP_CHANGES = _membership_changes()

TICKET_PATCHES = f"""
SELECT CAST(l_orderkey AS VARCHAR) AS ticket_id, l_shipdate AS patched_at,
       l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       CASE WHEN l_linestatus = 'F' THEN '' ELSE 'Part ' || CAST(l_partkey AS VARCHAR) END AS title,
       CAST(NULL AS VARCHAR) AS content,
       CASE WHEN l_returnflag = 'N' THEN '' ELSE {case('l_returnflag', RETURNFLAG_STATUS)} END AS status,
       l_discount >= 0.05 AS has_assignee_id,
       CASE WHEN l_tax >= 0.04 THEN l_suppkey END AS assignee_id
FROM lineitem"""

TICKET_SUGGESTIONS = """
SELECT concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                 CAST(l_suppkey AS VARCHAR), CAST(datediff('day', DATE '1970-01-01', l_shipdate) AS VARCHAR))
         AS source_key,
       o_custkey AS meeting_id, 'Part ' || CAST(l_partkey AS VARCHAR) AS title,
       'qty ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS content,
       CASE WHEN l_linestatus = 'O' THEN NULL ELSE 'IN_PROGRESS' END AS status,
       CAST(NULL AS BIGINT) AS assignee_id, l_shipdate AS created_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
