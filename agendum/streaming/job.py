"""The streaming analytics job: three event streams in, metric streams and
metric tables out.

    transcripts ─┐
                 ├─ productivity_score (A2, J1) ──┐
    tickets ─────┼─ ticket_metrics (A3) ──────────┤
      (S8: flat  ├─ trends (Z2, A8) ──────────────┼─ one foreachBatch per metric: topic (S3)
      updates    ├─ save_windows (Z6) ────────────┤  and table (S5, Z10); the hour-of-day
      get their  ├─ meeting_runs (Z7) ────────────┤  pattern is merged out of partial states
      meeting)   └─ meeting_sessions (Z8) ────────┘

Progress and late rows of every query go to a table (Z3). Every query gets its own checkpoint under the session's
``spark.checkpoint.dir``; shuffle partitions are fixed by the first
checkpoint, so they are set before the first start.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agendum.operators import metrics as M
from agendum.operators import sketches as K
from agendum.operators.trends import group_trends_stream
from agendum.sinks import writers as W
from agendum.streaming import operators as Z
from agendum.streaming.progress import ProgressTable
from agendum.streaming.state import meeting_state
from agendum.streaming.tickets import resolve_meetings
from agendum.sources.events import decode_transcripts, normalize_ticket_events, read_events, with_meeting
from agendum.session import stream_checkpoint

# --- fixed values -----------------------------------------------------------
TOPICS = {"transcripts": "transcription.completed", "ticket_created": "ticket.created",
          "ticket_updated": "ticket.updated"}
# ---------------------------------------------------------------------------


def transcript_stream(raw: DataFrame, with_markers: bool = False) -> DataFrame:
    """Kafka-shaped records → valid transcript segments with event time
    (payload time if present, else the record time)."""
    valid, _, markers = decode_transcripts(raw)
    both = valid if not with_markers else valid.unionByName(markers)
    return both.withColumnRenamed("event_ts", "ts").withColumn("seq", F.col("offset") if "offset" in both.columns else F.lit(None))


def ticket_stream(raw_created: DataFrame, raw_updated: DataFrame, tickets: DataFrame | None = None) -> DataFrame:
    """Both ticket topics → one row per ticket event with event time. Flat
    updates take their meeting from the ticket table, if one is given."""
    created = normalize_ticket_events(raw_created).withColumn("event_type", F.lit("created"))
    updated = normalize_ticket_events(raw_updated).withColumn("event_type", F.lit("updated"))
    if tickets is not None:
        updated = with_meeting(updated, tickets).select(*created.columns)
    both = created.unionByName(updated)
    return both.withColumn("ts", F.coalesce("updated_at", "created_at", "timestamp"))


def build(spark: SparkSession, sources: Mapping[str, DataFrame] | None = None,
          window: str = "1 minute", fmt: str = "kafka", options: Mapping[str, str] | None = None,
          tickets: DataFrame | None = None, meetings: DataFrame | None = None) -> dict[str, DataFrame]:
    """The job's output frames (not started). ``sources`` may hand in
    prepared raw streams (tests); otherwise the three topics are read.
    Flat ticket updates get the meeting of their ticket from the created topic and
    from ``tickets``, the ticket table at the start; those of unknown tickets count
    for no meeting. ``meetings``: meeting rows with their group, needed for trends.
    Repeated deliveries (same topic offset) count once."""
    if sources is None:
        sources = {k: read_events(spark, topic, options=options, fmt=fmt) for k, topic in TOPICS.items()}
    raw = sources["transcripts"]
    tr = _once(transcript_stream(raw), "2 minutes")
    marked = _once(transcript_stream(raw, with_markers=True), "2 minutes")
    streaming = sources["ticket_created"].isStreaming
    tk = _once(ticket_stream(sources["ticket_created"], sources["ticket_updated"], None if streaming else tickets), "10 minutes", ["event_type", "ticket_id"])
    if streaming:
        tk = resolve_meetings(tk, tickets)
    tk = tk.filter(F.col("meeting_id").isNotNull())
    outs = {
        "ticket_metrics": M.ticket_metrics(tk, window, watermark=None),
        "productivity": M.productivity_score(tr, tk, window, transcript_watermark=None, ticket_watermark=None),
        "transcript_saves": Z.save_windows(marked, watermark=None),
        "meeting_runs": meeting_state(marked, watermark=None) if streaming else Z.meeting_runs(marked),
        "meeting_sessions": Z.meeting_sessions(tr, watermark=None),
    }
    if meetings is not None:
        outs["trends"] = group_trends_stream(tr, tk, meetings, window, None, None)
    return outs


def _once(events: DataFrame, delay: str, more: Sequence[str] = ()) -> DataFrame:
    """Z4 on the wire: one row per record, remembered within the watermark,
    which later operators of the query share."""
    if not events.isStreaming:
        return events
    keys = [c for c in ("topic", "partition", "offset", *more) if c in events.columns]
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def start(spark: SparkSession, outputs: Mapping[str, DataFrame], metrics_target: str,
          topic_fmt: str = "kafka", topic_options: Mapping[str, str] | None = None,
          topic_path: str | None = None, prefix: str = "") -> list:
    """Start one query per metric. Each micro-batch is kept once and written to
    its table and, where the metric has a topic, to the topic. Query names (and
    so checkpoints) are stable across restarts; ``prefix`` separates independent
    deployments."""
    def writer(kind: str):
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.persist()
            try:
                W.write_metric_batch(batch, kind, metrics_target, batch_id)
                if kind in W.METRIC_TOPICS:
                    routed = W.route_metrics({kind: batch}).write.format(topic_fmt).options(**(topic_options or {}))
                    if topic_path:
                        routed.mode("overwrite").save(f"{topic_path}/{kind}/batch_id={batch_id}")
                    else:
                        routed.save()
                if kind == "productivity":
                    W.merge_metric_table(spark, K.hourly_partial(batch), f"{metrics_target}/hourly_pattern", ["hour_of_day"], K.HOURLY_MERGE, batch_id)
            finally:
                batch.unpersist()
        return write

    return [df.writeStream.outputMode("append").queryName(f"{prefix}{kind}")
            .option("checkpointLocation", stream_checkpoint(spark, f"{prefix}{kind}"))
            .foreachBatch(writer(kind)).start() for kind, df in outputs.items()]


def hourly_pattern(spark: SparkSession, metrics_target: str) -> DataFrame:
    """A6 over all micro-batches so far: the stored partial states, finished."""
    return K.finish_hourly(W.read_versioned(spark, f"{metrics_target}/hourly_pattern"))


def main() -> None:  # pragma: no cover - cluster entry point
    """Paths from the session: ``spark.agendum.metrics.path`` (output),
    ``spark.agendum.tickets.path`` and ``spark.agendum.meetings.path`` (tables)."""
    from agendum.session import build_session
    spark = build_session()
    table = lambda name: spark.read.parquet(spark.conf.get(f"spark.agendum.{name}.path"))
    target = spark.conf.get("spark.agendum.metrics.path")
    spark.streams.addListener(ProgressTable(spark, f"{target}/progress"))
    outs = build(spark, tickets=table("tickets"), meetings=table("meetings"))
    for q in start(spark, outs, target):
        q.awaitTermination()
