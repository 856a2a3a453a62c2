"""Model-answer documents: decode, apply, and build the model's input
(X1-X3, A10). The model call itself is outside this engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agendum import schemas as S
from agendum.functions.expressions import blank_to_null
from agendum.operators.relational import meeting_groups, patch
from agendum.operators.text import stitch_transcripts

# --- fixed values -----------------------------------------------------------
NO_TICKETS_LINE = "No existing tickets."      # the context's empty-ticket line
UPDATE_STATUSES = ("IN_PROGRESS", "DONE")     # what an answer may set a ticket to
BROADCAST_MEETINGS = 2_000_000                # ids of meetings sent to every task: 32 MB
# ---------------------------------------------------------------------------


def decode_analysis(docs: DataFrame, value: str = "value") -> dict[str, DataFrame]:
    """Parse each answer with the fixed nested schema. ``items``: new
    tickets and ticket updates of all answers, tagged by ``kind`` and numbered
    in their answer (one parse, one explode); ``meeting_metrics``; ``rejects``
    for unparsable documents. Keys (doc_id, meeting_id) are carried along."""
    keys = [c for c in docs.columns if c != value]
    p = docs.withColumn("__a", F.from_json(F.col(value), S.with_corrupt(S.ANALYSIS), S.JSON_OPTIONS)) \
            .withColumn("__bad", F.col("__a").isNull() | F.col(f"__a.{S.CORRUPT}").isNotNull())
    ok = p.filter(~F.col("__bad"))
    none = F.lit(None).cast("string")
    news = F.transform(F.coalesce("__a.newTickets", F.array()), lambda t, i: F.struct(
        F.lit("new").alias("kind"), i.cast("int").alias("item_no"), none.alias("ticket_id"), t["title"].alias("title"),
        t["content"].alias("content"), t["status"].alias("status"), t["assigneeId"].alias("assignee_id"), none.alias("reason")))
    updates = F.transform(F.coalesce("__a.ticketUpdates", F.array()), lambda u, i: F.struct(
        F.lit("update").alias("kind"), i.cast("int").alias("item_no"), u["ticketId"].alias("ticket_id"), none.alias("title"),
        none.alias("content"), u["newStatus"].alias("status"), u["assigneeId"].alias("assignee_id"), u["reason"].alias("reason")))
    items = ok.select(*keys, F.explode(F.concat(news, updates)).alias("t")).select(*keys, "t.*")
    met = ok.select(*keys, F.col("__a.meetingMetrics.actionableItemsCount").alias("actionable_items_count"),
                    F.col("__a.meetingMetrics.statusUpdatesCount").alias("status_updates_count"),
                    F.col("__a.meetingMetrics.blockersMentioned").alias("blockers_mentioned"))
    rej = p.filter(F.col("__bad")).select(*keys, F.lit("malformed").alias("reject_reason"))
    return {"items": items, "meeting_metrics": met, "rejects": rej}


def meeting_metrics_from_analysis(metrics: DataFrame) -> DataFrame:
    """A10: model-reported counters summed per meeting."""
    return metrics.groupBy("meeting_id").agg(
        F.sum("actionable_items_count").cast("long").alias("actionable_items_count"),
        F.sum("status_updates_count").cast("long").alias("status_updates_count"),
        F.sum("blockers_mentioned").cast("long").alias("blockers_mentioned"),
        F.count(F.lit(1)).alias("n_analyses"))


def apply_analysis(tickets: DataFrame, items: DataFrame, meetings: DataFrame, members: DataFrame) -> DataFrame:
    """Ticket events from the items of a batch of answers. A new ticket gets
    an id from its place (meeting, answer, item) and content, and status TODO when
    absent; an update must name an existing ticket and set one of
    ``UPDATE_STATUSES``; any assignee must belong to the meeting's group.
    Rejected items stay in the output with ``reject_reason``."""
    known = tickets.select("ticket_id", F.lit(True).alias("__known"))
    member = members.select("group_id", F.col("user_id").alias("assignee_id"), F.lit(True).alias("__member"))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    new_id = F.sha2(F.concat_ws("|", *[part(c) for c in ("meeting_id", "doc_id", "item_no", "title", "content")]), 256)
    is_new = F.col("kind") == "new"
    j = (items.join(meeting_groups(meetings), "meeting_id", "left").join(member, ["group_id", "assignee_id"], "left")
         .join(known, "ticket_id", "left"))
    reject = (F.when(~is_new & F.col("__known").isNull(), "unknown_ticket")
              .when(~is_new & ~F.coalesce(F.col("status").isin(*UPDATE_STATUSES), F.lit(False)), "bad_status")
              .when(F.col("assignee_id").isNotNull() & F.col("__member").isNull(), "assignee_not_member"))
    return j.select(F.when(is_new, "created").otherwise("updated").alias("event_type"), "doc_id", "item_no",
                    F.when(is_new, new_id).otherwise(F.col("ticket_id")).alias("ticket_id"), "meeting_id", "title", "content",
                    F.when(is_new, F.coalesce(blank_to_null(F.col("status")), F.lit("TODO"))).otherwise(F.col("status")).alias("status"),
                    "assignee_id", "reason", reject.alias("reject_reason"))


def tickets_after_analysis(tickets: DataFrame, events: DataFrame) -> DataFrame:
    """The ticket table after the accepted events: new tickets inserted,
    updates folded in (answer, item) order. Timestamps are left to the writer."""
    ok = events.filter(F.col("reject_reason").isNull())
    updates = ok.filter(F.col("event_type") == "updated").select(
        "ticket_id", "doc_id", "item_no", "status", "assignee_id", F.col("assignee_id").isNotNull().alias("has_assignee_id"))
    cols = ["ticket_id", "meeting_id", "title", "content", "status", "assignee_id"]
    kept = patch(tickets.select(*cols), updates, ["doc_id", "item_no"]).select(*cols)
    return kept.unionByName(ok.filter(F.col("event_type") == "created").select(*cols))


def analysis_context(segments: DataFrame, tickets: DataFrame, members: DataFrame, users: DataFrame,
                     meetings: DataFrame) -> DataFrame:
    """The model's input as ordered lines in long form (scope, scope_id,
    section, item, line). Scope ``meeting`` has transcript pieces, the meeting's
    groups, and one line per existing ticket (with its assignee) or the
    empty-ticket line; scope ``group`` has one line per member, once per group and
    not once per meeting. A consumer concatenates a meeting's lines and those of
    its groups in (section, item) order; no row holds more than one piece."""
    def lines(df: DataFrame, scope: str, scope_id: str, section: str, item: Column, line: Column) -> DataFrame:
        return df.select(F.lit(scope).alias("scope"), F.col(scope_id).alias("scope_id"), F.lit(section).alias("section"),
                         item.cast("string").alias("item"), line.alias("line"))

    names = users.select("user_id", blank_to_null(F.col("name")).alias("name"))
    mt = segments.select("meeting_id").distinct()
    # Tickets and meeting rows of other meetings are left where they are read.
    wanted = F.broadcast(mt) if mt.count() <= BROADCAST_MEETINGS else mt
    grp = meeting_groups(meetings.join(wanted, "meeting_id", "left_semi"))
    mem = members.join(grp.select("group_id").distinct(), "group_id", "left_semi").join(names, "user_id", "left")
    own = tickets.join(wanted, "meeting_id", "left_semi")
    none = mt.join(own.select("meeting_id").distinct(), "meeting_id", "left_anti")
    # Open tickets have no assignee; as join keys, all their nulls would meet in one task.
    held = own.filter(F.col("assignee_id").isNotNull()).join(
        names.withColumnsRenamed({"user_id": "assignee_id", "name": "assignee"}), "assignee_id", "left")
    tk = held.unionByName(own.filter(F.col("assignee_id").isNull()).withColumn("assignee", F.lit(None).cast("string")))
    return (lines(stitch_transcripts(segments), "meeting", "meeting_id", "1_transcript", F.col("piece"), F.col("transcript"))
            .unionByName(lines(grp, "meeting", "meeting_id", "2_group", F.col("group_id"), F.col("group_id").cast("string")))
            .unionByName(lines(mem, "group", "group_id", "2_members", F.col("user_id"),
                               F.format_string("- %s (ID: %d)", F.coalesce("name", F.lit("Unknown")), F.col("user_id"))))
            .unionByName(lines(tk, "meeting", "meeting_id", "3_tickets", F.col("ticket_id"),
                               F.format_string("- [%s] %s (ID: %s, Assignee: %s)", F.col("status"), F.col("title"), F.col("ticket_id"),
                                               F.coalesce("assignee", F.lit("Unassigned")))))
            .unionByName(lines(none, "meeting", "meeting_id", "3_tickets", F.lit(""), F.lit(NO_TICKETS_LINE))))
