"""Fixed schemas: event payloads on the wire and the canonical tables.

Payload field names are the wire names (camelCase); tables are snake_case.
Ids are BIGINT throughout (the wire sometimes carries them as strings).
"""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType, TimestampType)


def _s(*fields) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


# Transcript delivery (partial text, or the final marker with empty text). Ids
# come as numbers or strings: a string field takes both.
TRANSCRIPT_MESSAGE = _s(("meetingId", StringType()), ("audioId", StringType()), ("groupId", StringType()),
                        ("transcript", StringType()), ("isPartial", BooleanType()),
                        ("timestamp", TimestampType()))

TICKET_ITEM = _s(("ticketId", StringType()), ("title", StringType()), ("content", StringType()),
                 ("status", StringType()), ("meetingId", StringType()), ("assigneeId", StringType()),
                 ("createdAt", TimestampType()), ("updatedAt", TimestampType()),
                 ("assigneeName", StringType()))

# Superset of the bulk shape {meetingId, tickets[]} and the flat update shape.
TICKET_EVENT_ENVELOPE = _s(("meetingId", StringType()), ("tickets", ArrayType(TICKET_ITEM)),
                           ("ticketId", StringType()), ("status", StringType()),
                           ("assigneeId", StringType()), ("assigneeName", StringType()),
                           ("reason", StringType()))

# Model answer: new tickets, updates of existing tickets, meeting counters.
ANALYSIS = _s(
    ("newTickets", ArrayType(_s(("title", StringType()), ("content", StringType()), ("status", StringType()),
                                ("meetingId", LongType()), ("assigneeId", LongType())))),
    ("ticketUpdates", ArrayType(_s(("ticketId", StringType()), ("newStatus", StringType()),
                                   ("assigneeId", LongType()), ("reason", StringType())))),
    ("meetingMetrics", _s(("actionableItemsCount", LongType()), ("statusUpdatesCount", LongType()),
                          ("blockersMentioned", LongType()))),
)

LATENCY_METRICS = _s(("kafkaDeliveryTime", DoubleType()), ("whisperProcessingTime", DoubleType()),
                     ("totalProcessingTime", DoubleType()))

# Canonical tables (snake_case).
TRANSCRIPTS = _s(("meeting_id", LongType()), ("audio_id", LongType()), ("group_id", LongType()),
                 ("seq", LongType()), ("text", StringType()), ("is_partial", BooleanType()),
                 ("ts", TimestampType()))
TICKETS = _s(("ticket_id", StringType()), ("title", StringType()), ("content", StringType()),
             ("status", StringType()), ("meeting_id", LongType()), ("assignee_id", LongType()),
             ("created_at", TimestampType()), ("updated_at", TimestampType()))
TICKET_EVENTS = _s(*[(f.name, f.dataType) for f in TICKETS.fields],
                   ("event_type", StringType()), ("reason", StringType()),
                   ("assignee_name", StringType()), ("ts", TimestampType()))
TICKET_HISTORY = _s(("history_id", LongType()), ("ticket_id", StringType()), ("old_status", StringType()),
                    ("new_status", StringType()), ("reason", StringType()), ("changed_at", TimestampType()))
REALTIME_METRICS = _s(("meeting_id", LongType()), ("window_start", TimestampType()),
                      ("window_end", TimestampType()), ("productivity_score", DoubleType()),
                      ("ticket_count", LongType()), ("actionable_count", LongType()))
TICKET_PATTERN = _s(("meeting_id", LongType()), ("avg_status_change_duration", DoubleType()),
                    ("blocker_count", LongType()), ("analysis_date", TimestampType()))
PRODUCTIVITY_PATTERN = _s(("hour_of_day", IntegerType()), ("avg_score", DoubleType()),
                          ("meeting_count", LongType()))


CORRUPT = "_corrupt"


def with_corrupt(schema: StructType) -> StructType:
    """The schema plus a string field that receives unparsable records
    (``from_json`` option ``columnNameOfCorruptRecord``): malformed input is
    told apart from ``{}`` in the same parse."""
    return StructType(schema.fields + [StructField(CORRUPT, StringType(), True)])


JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
