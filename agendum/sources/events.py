"""Event sources and payload decoding.

``read_events`` is the one reader for batch tables, directory streams and
Kafka; decoding is ``from_json`` with a fixed schema (no inference).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agendum import schemas as S


def read_events(spark: SparkSession, source: str, schema=None, options: dict | None = None,
                fmt: str = "kafka", stream: bool = True) -> DataFrame:
    """Read a topic (``fmt='kafka'``, ``source`` = topic) or a directory
    (``json``/``parquet``) as a stream or a batch table.

    Kafka records are reduced to (key, value STRING, topic, partition, offset,
    timestamp); with a ``schema`` the JSON value is parsed and flattened,
    unparsable values give NULL fields (PERMISSIVE). Lost offsets fail the
    query and a trigger takes all there is, unless ``options`` say otherwise
    (``failOnDataLoss``, ``maxOffsetsPerTrigger``).
    """
    opts = dict(options or {})
    reader = spark.readStream if stream else spark.read
    if fmt == "kafka":
        opts.setdefault("subscribe", source)
        opts.setdefault("startingOffsets", "latest" if stream else "earliest")
        raw = reader.format("kafka").options(**opts).load()
        df = raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                        "topic", "partition", "offset", "timestamp")
    else:
        # Directory of payload files: the files hold the payload fields.
        r = reader.format(fmt).options(**opts)
        return r.schema(schema).load(source) if schema is not None else r.load(source)
    if schema is None:
        return df
    return decode_json(df, schema)


def decode_json(df: DataFrame, schema, value: str = "value") -> DataFrame:
    """Parse ``value`` with ``schema``, keep the record time, flatten."""
    keep = [c for c in ("topic", "partition", "offset", "timestamp") if c in df.columns]
    return df.select(*keep, F.from_json(F.col(value), schema).alias("data")).select(*keep, "data.*")


def read_table(spark: SparkSession, name: str, source: str, fmt: str = "parquet",
               options: dict | None = None) -> DataFrame:
    """Relational table scan: parquet/ORC path, or JDBC with partitioned
    reads (``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``
    in ``options``) so a large table is read by many tasks."""
    opts = dict(options or {})
    if fmt == "jdbc":
        opts.setdefault("dbtable", name)
        return spark.read.format("jdbc").option("url", source).options(**opts).load()
    return spark.read.format(fmt).options(**opts).load(f"{source}/{name}.{fmt}" if fmt == "parquet" else source)


def wire_id(col: str) -> Column:
    """An id sent as a number or a string; NULL for what is neither."""
    return F.col(col).try_cast("long")


def decode_transcripts(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parse transcript deliveries; a missing payload counts as ``{}``.

    Returns (valid, rejects with a reason, final markers). Valid rows have
    meetingId, audioId and groupId, all non-zero (JS falsy rule). A meeting's
    final marker has a meeting, ``isPartial`` false, no text and no audio: its
    audio_id and group_id are NULL. ``event_ts`` is the payload's time, else the
    record's; there is no clock fallback, so a replay gives the same rows."""
    parsed = messages.withColumn(
        "__p", F.from_json(F.coalesce(F.col(value), F.lit("{}")), S.with_corrupt(S.TRANSCRIPT_MESSAGE),
                           S.JSON_OPTIONS))
    given = lambda c: F.coalesce(wire_id(f"__p.{c}"), F.lit(0)) != 0
    ids_ok = given("meetingId") & given("audioId") & given("groupId")
    marker = (given("meetingId") & ~ids_ok & (F.col("__p.isPartial") == F.lit(False))
              & (F.coalesce(F.col("__p.transcript"), F.lit("")) == ""))
    record_ts = F.col("timestamp") if "timestamp" in messages.columns else F.lit(None).cast("timestamp")
    rest = [c for c in messages.columns if c != value]
    flat = parsed.select(*rest, value,
                         wire_id("__p.meetingId").alias("meeting_id"), wire_id("__p.audioId").alias("audio_id"),
                         wire_id("__p.groupId").alias("group_id"), F.col("__p.transcript").alias("text"),
                         F.coalesce(F.col("__p.isPartial"), F.lit(False)).alias("is_partial"),
                         F.coalesce(F.col("__p.timestamp"), record_ts).alias("event_ts"),
                         F.coalesce(F.when(ids_ok, "valid").when(marker, "marker"), F.lit("reject")).alias("__kind"),
                         (F.col("__p").isNull() | F.col(f"__p.{S.CORRUPT}").isNotNull()).alias("__bad"))
    valid = flat.filter(F.col("__kind") == "valid").drop("__kind", "__bad", value)
    markers = (flat.filter(F.col("__kind") == "marker").drop("__kind", "__bad", value)
               .withColumn("audio_id", F.lit(None).cast("long")).withColumn("group_id", F.lit(None).cast("long")))
    rejects = (flat.filter(F.col("__kind") == "reject")
               .withColumn("reject_reason", F.when(F.col("__bad"), F.lit("malformed"))
                                              .otherwise(F.lit("missing_id")))
               .drop("__kind", "__bad"))
    return valid, rejects, markers


def with_meeting(events: DataFrame, tickets: DataFrame) -> DataFrame:
    """Flat updates name no meeting; they get their ticket's (a
    stream-static join on a stream)."""
    known = tickets.select("ticket_id", F.col("meeting_id").alias("__ticket_meeting"))
    return (events.join(known, "ticket_id", "left")
            .withColumn("meeting_id", F.coalesce("meeting_id", "__ticket_meeting")).drop("__ticket_meeting"))


def normalize_ticket_events(messages: DataFrame, value: str = "value",
                            ts: str = "timestamp") -> DataFrame:
    """Ticket events arrive as ``{meetingId, tickets:[...]}`` (created or
    updated in bulk) or as one flat update ``{ticketId, status, ...}``. Both
    become one row per ticket; the flat form is wrapped into a one-element
    array so one ``explode`` serves both."""
    p = messages.withColumn("__p", F.from_json(F.col(value), S.TICKET_EVENT_ENVELOPE))
    flat = F.struct(
        F.col("__p.ticketId").alias("ticketId"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("content"), F.col("__p.status").alias("status"),
        F.col("__p.meetingId").alias("meetingId"), F.col("__p.assigneeId").alias("assigneeId"),
        F.lit(None).cast("timestamp").alias("createdAt"), F.lit(None).cast("timestamp").alias("updatedAt"),
        F.col("__p.assigneeName").alias("assigneeName"))
    items = F.when(F.col("__p.tickets").isNotNull(), F.col("__p.tickets")).otherwise(
        F.when(F.col("__p.ticketId").isNotNull(), F.array(flat)))
    keep = [c for c in messages.columns if c != value]
    out = p.select(*keep, F.col("__p.meetingId").alias("__mid"), F.col("__p.reason").alias("reason"),
                   F.explode(items).alias("t"))
    return out.select(
        *keep,
        F.col("t.ticketId").alias("ticket_id"),
        F.coalesce(wire_id("t.meetingId"), wire_id("__mid")).alias("meeting_id"),
        F.col("t.title").alias("title"), F.col("t.content").alias("content"),
        F.col("t.status").alias("status"), wire_id("t.assigneeId").alias("assignee_id"),
        F.col("t.assigneeName").alias("assignee_name"), F.col("t.createdAt").alias("created_at"),
        F.col("t.updatedAt").alias("updated_at"), "reason")
