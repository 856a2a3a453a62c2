"""Sinks and sources: event values, topic routing, idempotent metric writes,
JDBC (embedded in-memory Derby: no server, no port), and the job wiring."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from agendum.sinks import writers as W
from agendum.sources.events import read_table
from agendum.streaming import job
from tests.conftest import rows_of


def test_event_value_round_trip_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3.5)], "id long, s string, x double")
    vals = [json.loads(r.value) for r in W.to_event_value(df, key="id").collect()]
    assert sorted(vals, key=lambda v: v["id"]) == [{"id": 1, "s": "a", "x": None}, {"id": 2, "s": None, "x": 3.5}]


def test_route_metrics_envelopes(spark):
    a = spark.createDataFrame([(1, 2)], "meeting_id long, n long")
    b = spark.createDataFrame([(3, 4.0)], "meeting_id long, score double")
    out = W.route_metrics({"ticket_metrics": a, "productivity": b}, ts=None, key="meeting_id").collect()
    got = sorted((r.topic, r.key, json.loads(r.value)["type"], json.loads(r.value)["data"]["meeting_id"]) for r in out)
    assert got == [("analytics.productivity", "3", "productivity", 3),
                   ("analytics.ticket.metrics", "1", "ticket_metrics", 1)]


def test_metric_batch_write_is_idempotent(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "meeting_id")
    for _ in range(2):          # a replayed micro-batch rewrites its own folder
        W.write_metric_batch(df, "realtime", str(tmp_path), 7)
    assert spark.read.parquet(f"{tmp_path}/realtime").count() == 5


def test_upsert_metric_table_versions(spark, tmp_path):
    v1 = spark.createDataFrame([(9, 1.0, 1), (10, 2.0, 1)], "hour_of_day int, avg_score double, meeting_count long")
    v2 = spark.createDataFrame([(10, 3.0, 2), (11, 4.0, 1)], "hour_of_day int, avg_score double, meeting_count long")
    W.upsert_metric_table(spark, v1, str(tmp_path), ["hour_of_day"], ["avg_score", "meeting_count"], 1)
    for _ in range(2):      # rewriting a version gives the same table
        p = W.upsert_metric_table(spark, v2, str(tmp_path), ["hour_of_day"], ["avg_score", "meeting_count"], 2)
        assert rows_of(spark.read.parquet(p)) == [(9, 1.0, 1), (10, 3.0, 2), (11, 4.0, 1)]


def test_jdbc_write_and_partitioned_read(spark):
    url = f"jdbc:derby:memory:agendum{uuid.uuid4().hex[:6]};create=true"
    drv = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.createDataFrame([(i, f"t{i}", "TODO") for i in range(20)], "ticket_no long, title string, status string")
    W.write_jdbc(df, url, "TICKETS", "overwrite", drv)
    back = read_table(spark, "TICKETS", url, fmt="jdbc",
                      options={**drv, "partitionColumn": "TICKET_NO", "lowerBound": "0", "upperBound": "20",
                               "numPartitions": "4"})
    assert back.rdd.getNumPartitions() == 4
    assert rows_of(back.toDF("ticket_no", "title", "status")) == rows_of(df)


def test_job_wiring_on_file_streams(spark, tmp_path):
    base = "2024-03-20 10:00:"
    tr = spark.createDataFrame(
        [(i, f"{base}{i:02d}", json.dumps({"meetingId": 131, "audioId": 315, "groupId": 1,
                                           "transcript": f"seg {i}", "isPartial": True})) for i in range(1, 6)]
        + [(99, "2024-03-20 11:00:00", json.dumps({"meetingId": 131, "audioId": 315, "groupId": 1,
                                                   "transcript": "late", "isPartial": True}))],
        "offset long, timestamp string, value string").withColumn("timestamp", F.to_timestamp("timestamp"))
    created = spark.createDataFrame(
        [(1, f"{base}30", json.dumps({"meetingId": 131, "tickets": [
            {"ticketId": "a", "title": "Write document", "status": "TODO", "createdAt": "2024-03-20T10:00:30"},
            {"ticketId": "b", "title": "Design UI", "status": "IN_PROGRESS", "createdAt": "2024-03-20T10:00:31"}]})),
         (2, "2024-03-20 11:00:00", json.dumps({"meetingId": 131, "tickets": [
             {"ticketId": "c", "title": "later", "status": "TODO", "createdAt": "2024-03-20T11:00:00"}]}))],
        "offset long, timestamp string, value string").withColumn("timestamp", F.to_timestamp("timestamp"))
    updated = spark.createDataFrame(
        [(7, f"{base}40", json.dumps({"ticketId": "a", "status": "DONE", "reason": "done"})),
         (7, f"{base}40", json.dumps({"ticketId": "a", "status": "DONE", "reason": "done"}))],      # delivered twice
        "offset long, timestamp string, value string").withColumn("timestamp", F.to_timestamp("timestamp"))
    marker = spark.createDataFrame([(6, f"{base}50", json.dumps({"meetingId": 131, "transcript": "", "isPartial": False}))],
                                   "offset long, timestamp string, value string").withColumn("timestamp", F.to_timestamp("timestamp"))
    tr = tr.unionByName(marker)
    tickets = spark.createDataFrame([("old", 131)], "ticket_id string, meeting_id long")
    srcs = {}
    for name, df in (("transcripts", tr), ("ticket_created", created), ("ticket_updated", updated)):
        path = f"{tmp_path}/{name}"
        df.write.parquet(path)
        srcs[name] = spark.readStream.schema(df.schema).parquet(path)
    meetings = spark.createDataFrame([(131, 1, 315), (131, 1, 316)], "meeting_id long, group_id long, audio_id long")
    outs = job.build(spark, srcs, window="1 minute", tickets=tickets, meetings=meetings)
    target = f"{tmp_path}/metrics"
    queries = job.start(spark, outs, target, topic_fmt="json", topic_path=f"{tmp_path}/topics",
                        prefix=f"t{uuid.uuid4().hex[:8]}_")
    for q in queries:
        q.processAllAvailable()
        q.stop()
    tm = spark.read.parquet(f"{target}/ticket_metrics")
    assert rows_of(tm, ["meeting_id", "actionable_items_count", "status_updates_count"]) == [(131, 2, 3)]
    prod = spark.read.parquet(f"{target}/productivity")
    assert rows_of(prod, ["meeting_id", "segment_count", "ticket_count"]) == [(131, 5, 3)]
    saves = spark.read.parquet(f"{target}/transcript_saves")
    assert rows_of(saves, ["text", "is_final"]) == [("", True), ("seg 1 seg 2 seg 3 seg 4 seg 5", False)]
    # Two actionable of three ticket events: 0.6 * 2 + 0.4 * 3.
    assert rows_of(job.hourly_pattern(spark, target)) == [(10, 2.4, 1, 1)]
    runs = spark.read.parquet(f"{target}/meeting_runs")
    assert rows_of(runs, ["meeting_id", "n_partials", "ended"]) == [(131, 5, True)]
    routed = spark.read.json(f"{tmp_path}/topics/productivity")
    assert {r.topic for r in routed.collect()} == {"analytics.productivity"}
