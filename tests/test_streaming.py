"""Stream = batch: the same operator over a file stream (files in event-time
order, then two closing files far in the future with a sentinel meeting -1,
drained with availableNow) gives the batch result."""

from __future__ import annotations

import os
import uuid

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from agendum.operators import metrics as M
from agendum.streaming import operators as Z
from agendum.streaming.state import meeting_state
from tests.conftest import rows_of

SENTINEL = -1
STREAM_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def events_dir(spark, sf_dir, tmp_path_factory):
    """events of the small tables, one file per week in time order (UTC
    timestamps), duplicated once (every event delivered twice), plus two
    closing files."""
    d = tmp_path_factory.mktemp("events_stream")
    tbl = pq.read_table(f"{sf_dir}/events.parquet")
    tbl = tbl.set_column(tbl.schema.get_field_index("ts"), "ts",
                         tbl.column("ts").cast(pa.timestamp("us", tz="UTC")))
    df = tbl.to_pandas().sort_values("ts")
    week = df["ts"].dt.strftime("%G-%V")
    mtime = 1_700_000_000
    for i, (_, part) in enumerate(df.groupby(week, sort=True)):
        for copy in range(2):
            path = os.path.join(d, f"{i:03d}-{copy}.parquet")
            pq.write_table(pa.Table.from_pandas(part, preserve_index=False), path)
            mtime += 10
            os.utime(path, (mtime, mtime))
    first = pa.Table.from_pandas(df.iloc[:1], preserve_index=False)
    for j, ts in enumerate(("2030-01-01", "2030-02-01")):
        close = (first.set_column(first.schema.get_field_index("ts"), "ts",
                                  pa.array([pd.Timestamp(ts, tz="UTC")], pa.timestamp("us", tz="UTC")))
                 .set_column(first.schema.get_field_index("user_id"), "user_id", pa.array([SENTINEL], pa.int64()))
                 .set_column(first.schema.get_field_index("event_id"), "event_id", pa.array([-1 - j], pa.int64())))
        path = os.path.join(d, f"999-close-{j}.parquet")
        pq.write_table(close, path)
        mtime += 10
        os.utime(path, (mtime, mtime))
    return str(d)


def stream(spark, path):
    return spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", 2).parquet(path)


def drain(df, mode="append"):
    name = "q_" + uuid.uuid4().hex[:8]
    spark = df.sparkSession
    from agendum.session import stream_checkpoint
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", stream_checkpoint(spark, name))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


def batch_events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def as_text(df, cols):
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols])


def test_ticket_metrics_stream_equals_batch(spark, sf_dir, events_dir):
    def prep(e):
        return e.dropDuplicates(["event_id"]) if not e.isStreaming else e
    s = Z.dedup_events(stream(spark, events_dir), ["event_id"], "ts", "1 day")
    s_tickets = s.select(F.col("event_id").cast("string").alias("ticket_id"), F.col("user_id").alias("meeting_id"),
                         "ts", F.col("event_type").alias("content"),
                         F.when(F.col("event_type") == "view", "TODO").otherwise("DONE").alias("status"))
    got = drain(M.ticket_metrics(s_tickets, "1 day", "(?i)error", watermark=None))
    got = got.filter(F.col("meeting_id") != SENTINEL)
    b = prep(batch_events(spark, sf_dir))
    b_tickets = b.select(F.col("event_id").cast("string").alias("ticket_id"), F.col("user_id").alias("meeting_id"),
                         "ts", F.col("event_type").alias("content"),
                         F.when(F.col("event_type") == "view", "TODO").otherwise("DONE").alias("status"))
    want = M.ticket_metrics(b_tickets, "1 day", "(?i)error")
    cols = ["window_start", "meeting_id", "actionable_items_count", "status_updates_count", "blockers_mentioned"]
    assert rows_of(as_text(got, cols)) == rows_of(as_text(want, cols))


def test_productivity_join_stream_equals_batch(spark, sf_dir, events_dir):
    def parts(e):
        segs = e.select(F.col("user_id").alias("meeting_id"), "ts")
        tick = e.select(F.col("event_id").cast("string").alias("ticket_id"), F.col("user_id").alias("meeting_id"),
                        "ts", F.when(F.col("event_type") == "view", "TODO").otherwise("DONE").alias("status"))
        return segs, tick
    s = stream(spark, events_dir)
    got = drain(M.productivity_score(*parts(s), "1 day")).filter(F.col("meeting_id") != SENTINEL)
    b = batch_events(spark, sf_dir)
    segs, tick = parts(b.unionByName(b))        # the stream sees every event twice
    want = M.productivity_score(segs, tick, "1 day")
    cols = ["window_start", "meeting_id", "segment_count", "ticket_count", "actionable_tickets"]
    assert rows_of(as_text(got, cols)) == rows_of(as_text(want, cols))


def test_sessions_stream_equals_batch(spark, sf_dir, events_dir):
    s = Z.dedup_events(stream(spark, events_dir), ["event_id"], "ts", "1 day")
    got = drain(Z.meeting_sessions(s.select(F.col("user_id").alias("meeting_id"), "ts",
                                            F.col("event_id").alias("seq")), "6 hours", watermark=None))
    got = got.filter(F.col("meeting_id") != SENTINEL)
    b = batch_events(spark, sf_dir).select(F.col("user_id").alias("meeting_id"), "ts", F.col("event_id").alias("seq"))
    want = Z.meeting_sessions(b, "6 hours")
    cols = ["meeting_id", "session_start", "session_end", "n_events"]
    assert rows_of(as_text(got, cols)) == rows_of(as_text(want, cols))


def test_meeting_state_stream_equals_batch_twin(spark, sf_dir, events_dir):
    def segs(e):
        return e.select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("audio_id"),
                        F.get_json_object("props", "$.k").cast("long").alias("group_id"),
                        F.col("event_id").alias("seq"), F.col("event_type").alias("text"),
                        (F.col("event_type") != "purchase").alias("is_partial"), "ts")
    s = Z.dedup_events(stream(spark, events_dir), ["event_id"], "ts", "1 day")
    got = drain(meeting_state(segs(s), "1 hour", watermark=None)).filter(F.col("meeting_id") != SENTINEL)
    want = Z.meeting_runs(segs(batch_events(spark, sf_dir)), "1 hour")
    cols = ["meeting_id", "audio_id", "group_id", "n_partials", "n_chars", "first_ts", "last_ts", "ended"]
    assert rows_of(as_text(got, cols)) == rows_of(as_text(want, cols))


def test_timeout_join_stream_equals_batch(spark, sf_dir, events_dir):
    def sides(e):
        e = e.select("event_id", F.col("user_id").alias("meeting_id"), "ts", "event_type")
        req = e.filter(F.col("event_type") == "error").select(F.col("event_id").alias("request_id"),
                                                              "meeting_id", "ts")
        arr = e.filter(F.col("event_type") == "view").select("meeting_id", "ts")
        return req, arr
    s = Z.dedup_events(stream(spark, events_dir), ["event_id"], "ts", "1 day")
    # One row per request: the first match only, from the operator itself.
    got = drain(Z.await_transcripts(*sides(s), "6 hours", 6 * 3600, watermark=None)).filter(F.col("meeting_id") != SENTINEL)
    assert got.count() == got.select("request_id").distinct().count()
    want = Z.await_transcripts(*sides(batch_events(spark, sf_dir)), "6 hours", 6 * 3600)
    cols = ["request_id", "first_transcript_at"]
    assert rows_of(as_text(got, cols)) == rows_of(as_text(want, cols))
