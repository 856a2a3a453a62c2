"""Logical tables of the engine mapped onto the driver's parquet tables.

Each function reads one or two parquet tables and projects them into the
canonical snake_case schema (see ``agendum.schemas``). Only the columns a
logical table needs are selected, so Catalyst prunes the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agendum.functions.expressions import map_values

# --- fixed values -----------------------------------------------------------
# How the generic test tables stand in for tickets and their statuses.
EVENT_STATUS = {"view": "TODO", "click": "IN_PROGRESS", "signup": "IN_PROGRESS",
                "error": "IN_PROGRESS", "purchase": "DONE"}
ORDER_STATUS = {"O": "TODO", "P": "IN_PROGRESS", "F": "DONE"}
RETURNFLAG_STATUS = {"N": "TODO", "A": "IN_PROGRESS", "R": "DONE"}
EVENT_BLOCKER_PATTERN = "(?i)error"
ORDER_BLOCKER_PATTERN = "(?i)urgent"
SHORT_CHUNK_BYTES = 300          # audio chunk "short" limit on documents.n_chars
ADMIN_EVERY = 10                 # users with user_id % 10 = 0 are group admins
# ---------------------------------------------------------------------------

# Columns that give lineitem rows a total order inside one order key.
HISTORY_TIEBREAK = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticket_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket events on the event stream table (one event per row)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id"),
        F.col("event_id").cast("string").alias("ticket_id"),
        F.col("user_id").alias("meeting_id"),
        F.col("ts"),
        F.col("event_type").alias("title"),
        F.col("event_type").alias("content"),
        map_values("event_type", EVENT_STATUS).alias("status"),
    )


def timed_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments with event time (meeting = user)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("meeting_id"),
        F.col("ts"),
        F.col("event_type").alias("text"),
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket snapshot on orders (ticket = order, meeting = customer)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("ticket_id"),
        F.col("o_custkey").alias("meeting_id"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderpriority").alias("content"),
        map_values("o_orderstatus", ORDER_STATUS).alias("status"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("long"))
         .otherwise(F.col("o_custkey")).alias("assignee_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def ticket_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes on lineitem (ticket = order, one change per line)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("ticket_id"),
        F.col("l_linenumber").cast("long").alias("history_id"),
        F.col("l_shipdate").alias("changed_at"),
        map_values("l_returnflag", RETURNFLAG_STATUS).alias("new_status"),
        *[F.col(c) for c in HISTORY_TIEBREAK],
    )


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meeting rows: one per audio, two audios a meeting."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("meeting_id"),
                    F.col("c_nationkey").cast("long").alias("group_id"),
                    F.explode(F.array(F.col("c_custkey") * 10, F.col("c_custkey") * 10 + 1)).alias("audio_id"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"),
                    F.col("c_name").alias("name"),
                    F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@corp.test")).alias("email"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("group_id"),
                    F.col("n_name").alias("name"))


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_nationkey").cast("long").alias("group_id"),
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_custkey") % ADMIN_EVERY == 0, F.lit("ADMIN")).otherwise(F.lit("MEMBER")).alias("role"),
    )


def ordered_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments in turn order; two audio streams per meeting."""
    cv = table(spark, sf_dir, "conversations")
    return cv.select(
        F.col("conv_id").alias("meeting_id"),
        (F.col("conv_id") * 10 + F.col("turn") % 2).alias("audio_id"),
        F.col("turn").alias("seq"),
        F.col("role").alias("speaker"),
        F.col("text"),
    )


# What is said in the turns of a conversation, by turn number modulo their count;
# {name} is the meeting's own member.
SPOKEN = ("The API documentation is in progress.", "The login page has been completed!", "Ask {name}, who will do it.",
          "{name} is willing to listen.", "{name} is working on this.", "백엔드 작업이 완료되었습니다.", "Nothing new.")


def member_name(meeting_id: str = "conv_id") -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(F.col(meeting_id).cast("string"), 9, "0"))


def spoken_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments whose last sentence announces, assigns or does neither."""
    said = F.element_at(F.array(*[F.lit(x) for x in SPOKEN]), (F.col("turn") % len(SPOKEN) + 1).cast("int"))
    cv = table(spark, sf_dir, "conversations")
    return cv.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("seq"),
                     F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.replace(said, F.lit("{name}"), member_name())).alias("text"))


def transcript_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text")


def audio_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio chunk metadata: meeting = language, seq = doc id, size = chars."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("meeting_id"), F.col("doc_id").alias("seq"),
                    F.col("n_chars").alias("n_bytes"))


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("meeting_id"),
                     F.col("l_quantity").alias("kafka_delivery_ms"),
                     F.col("l_extendedprice").alias("processing_ms"),
                     F.col("l_discount").alias("total_ms"))


# --- derived change feeds ----------------------------------------------------
# Membership change requests on customer rows: the user of each block of ten
# ids (an admin of its own group) asks to change the target user's membership.
MEMBERSHIP_ACTIONS = ("create", "invite", "role", "remove")
OTHER_DOMAIN_SEGMENT = "HOUSEHOLD"     # these targets use an e-mail no user has
ROLE_BY_SEGMENT = {"BUILDING": "ADMIN", "MACHINERY": "OWNER"}   # anything else: MEMBER


def membership_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    action = F.element_at(F.array(*[F.lit(a) for a in MEMBERSHIP_ACTIONS]),
                          (F.col("c_custkey") % len(MEMBERSHIP_ACTIONS) + 1).cast("int"))
    local = F.lower(F.regexp_replace("c_name", "#", "."))
    email = (F.when(F.col("c_acctbal") < 0, F.col("c_name"))
              .when(F.col("c_mktsegment") == OTHER_DOMAIN_SEGMENT, F.concat(local, F.lit("@other.test")))
              .otherwise(F.concat(local, F.lit("@corp.test"))))
    return c.select(
        F.col("c_custkey").alias("change_id"),
        (F.col("c_custkey") - F.col("c_custkey") % ADMIN_EVERY).alias("requester_id"),
        F.col("c_nationkey").cast("long").alias("group_id"),
        action.alias("action"),
        F.col("c_name").alias("name"),
        email.alias("email"),
        map_values("c_mktsegment", ROLE_BY_SEGMENT, "MEMBER").alias("new_role"),
    )


def ticket_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial ticket updates, one per lineitem row (several per ticket)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("ticket_id"),
        F.col("l_shipdate").alias("patched_at"),
        *[F.col(c) for c in HISTORY_TIEBREAK],
        F.when(F.col("l_linestatus") == "F", F.lit(""))
         .otherwise(F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))).alias("title"),
        F.lit(None).cast("string").alias("content"),
        F.when(F.col("l_returnflag") == "N", F.lit(""))
         .otherwise(map_values("l_returnflag", RETURNFLAG_STATUS)).alias("status"),
        (F.col("l_discount") >= 0.05).alias("has_assignee_id"),
        F.when(F.col("l_tax") >= 0.04, F.col("l_suppkey")).alias("assignee_id"),
    )


def ticket_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New-ticket suggestions: one per lineitem, in the meeting of its order."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                      F.unix_date(F.to_date("l_shipdate")).cast("string"))
    return j.select(
        key.alias("source_key"),
        F.col("o_custkey").alias("meeting_id"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"),
        F.concat(F.lit("qty "), F.col("l_quantity").cast("long").cast("string")).alias("content"),
        F.when(F.col("l_linestatus") == "O", F.lit(None).cast("string")).otherwise(F.lit("IN_PROGRESS")).alias("status"),
        F.lit(None).cast("long").alias("assignee_id"),
        F.col("l_shipdate").alias("created_at"),
    )


# Event types that stand for special deliveries.
MALFORMED_EVENT_TYPE = "error"   # a cut-off JSON value
MARKER_EVENT_TYPE = "purchase"   # the meeting's final marker: no audio, no group, no text
STRING_ID_EVENT_TYPE = "click"   # ids sent as strings
TIMED_EVENT_TYPE = "signup"      # a payload time one minute before the record's


def transcript_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript deliveries as a JSON ``value`` column, like a Kafka record."""
    e = table(spark, sf_dir, "events")
    is_type = lambda t: F.col("event_type") == t
    group = F.get_json_object("props", "$.k").cast("long")
    fields = [("transcript", F.col("event_type")), ("isPartial", F.lit(True)),
              ("timestamp", F.when(is_type(TIMED_EVENT_TYPE), F.col("ts") - F.expr("INTERVAL 1 MINUTE")))]

    def payload(cast: str) -> Column:
        ids = [("meetingId", F.col("user_id")), ("audioId", F.col("event_id")), ("groupId", group)]
        return F.to_json(F.struct(*[c.cast(cast).alias(n) for n, c in ids], *[c.alias(n) for n, c in fields]))

    marker = F.to_json(F.struct(F.col("user_id").alias("meetingId"), F.lit("").alias("transcript"), F.lit(False).alias("isPartial")))
    value = (F.when(is_type(MALFORMED_EVENT_TYPE), F.substring(payload("long"), 1, 20)).when(is_type(MARKER_EVENT_TYPE), marker)
             .when(is_type(STRING_ID_EVENT_TYPE), payload("string")).otherwise(payload("long")))
    return e.select(F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"), value.alias("value"))


def ticket_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket deliveries: per order one bulk message that creates it, per
    lineitem with a status one flat update, which names no meeting."""
    o = table(spark, sf_dir, "orders")
    created = o.select(F.col("o_orderdate").alias("timestamp"), F.to_json(F.struct(
        F.col("o_custkey").cast("string").alias("meetingId"), F.array(F.struct(
            F.col("o_orderkey").cast("string").alias("ticketId"), F.col("o_orderpriority").alias("title"),
            map_values("o_orderstatus", ORDER_STATUS).alias("status"))).alias("tickets"))).alias("value"))
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") != "N")
    updated = li.select(F.col("l_shipdate").alias("timestamp"), F.to_json(F.struct(
        F.col("l_orderkey").cast("string").alias("ticketId"), map_values("l_returnflag", RETURNFLAG_STATUS).alias("status"),
        F.col("l_suppkey").alias("assigneeId"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("reason"))).alias("value"))
    return created.unionByName(updated)


MALFORMED_PRIORITY = "5-LOW"   # analysis documents of these orders are cut off


def analysis_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model-answer JSON document per order (meeting = its customer):
    open lines propose new tickets, finished lines update tickets (lines
    flagged N point at ids that do not exist)."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    status = map_values("l_returnflag", RETURNFLAG_STATUS)
    new_item = F.when(F.col("l_linestatus") == "O", F.struct(
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"),
        F.concat(F.lit("qty "), F.col("l_quantity").cast("long").cast("string")).alias("content"),
        F.when(F.col("l_returnflag") == "N", F.lit(None).cast("string")).otherwise(status).alias("status"),
        F.col("o_custkey").alias("meetingId"), F.col("l_suppkey").alias("assigneeId")))
    upd_item = F.when(F.col("l_linestatus") == "F", F.struct(
        F.when(F.col("l_returnflag") == "N",
               F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
         .otherwise(F.col("l_orderkey").cast("string")).alias("ticketId"),
        status.alias("newStatus"),
        F.when(F.col("l_tax") >= 0.04, F.col("l_suppkey")).alias("assigneeId"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("reason")))

    def in_order(item: Column) -> Column:
        """The order's items by line (an order has a handful)."""
        key = F.struct(*[F.col(c) for c in HISTORY_TIEBREAK])
        return F.transform(F.array_sort(F.collect_list(F.when(item.isNotNull(), F.struct(key.alias("k"), item.alias("i"))))), lambda x: x["i"])

    docs = j.groupBy("o_orderkey", "o_custkey", "o_orderpriority").agg(
        in_order(new_item).alias("newTickets"), in_order(upd_item).alias("ticketUpdates"),
        F.struct(F.sum((F.col("l_linestatus") == "F").cast("long")).alias("actionableItemsCount"),
                 F.count(F.lit(1)).alias("statusUpdatesCount"),
                 F.sum((F.col("l_returnflag") == "R").cast("long")).alias("blockersMentioned")).alias("meetingMetrics"))
    value = F.to_json(F.struct("newTickets", "ticketUpdates", "meetingMetrics"))
    return docs.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("meeting_id"),
                       F.when(F.col("o_orderpriority") == MALFORMED_PRIORITY, F.substring(value, 1, 30))
                        .otherwise(value).alias("value"))
