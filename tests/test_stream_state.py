"""Keyed state, chained windows, partial states and progress of the streams."""

from __future__ import annotations

import datetime as dt
import itertools
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from agendum.operators import metrics as M
from agendum.operators import sketches as K
from agendum.operators.trends import group_trends, group_trends_stream
from agendum.session import stream_checkpoint
from agendum.sinks import writers as W
from agendum.streaming import operators as Z
from agendum.streaming.progress import ProgressTable, read_progress
from agendum.streaming.state import meeting_state
from agendum.streaming.tickets import resolve_meetings
from tests.conftest import rows_of

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)     # a Monday
FAR = (100_000, 200_000)                                    # minutes: files that close all windows
_clock = itertools.count(1_700_000_000, 10)


def at(minutes: float) -> dt.datetime:
    return BASE + dt.timedelta(minutes=minutes)


def write_file(spark, folder, rows, schema):
    """One parquet file of the stream, younger than those before it."""
    tmp = f"{folder}-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(tmp)
    os.makedirs(folder, exist_ok=True)
    name = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
    target = f"{folder}/{uuid.uuid4().hex}.parquet"
    os.link(f"{tmp}/{name}", target)
    t = next(_clock)
    os.utime(target, (t, t))


def stream(spark, folder, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*.parquet")


def drain(df, name=None):
    name = name or "q_" + uuid.uuid4().hex[:8]
    q = (df.writeStream.outputMode("append").format("memory").queryName(name)
         .option("checkpointLocation", stream_checkpoint(df.sparkSession, name)).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def text(df, cols):
    return rows_of(df.select(*[F.col(c).cast("string").alias(c) for c in cols]))


# --- S8 -----------------------------------------------------------------------

TICKETS = "ticket_id string, meeting_id long, event_type string, ts timestamp, n int"


def resolved(spark, folder, tickets=None, **kw):
    s = stream(spark, folder, TICKETS).withWatermark("ts", "10 minutes")
    return drain(resolve_meetings(s, tickets, **kw)).filter(F.col("n") >= 0)


def closing(spark, folder):
    for i, m in enumerate(FAR):
        write_file(spark, folder, [("end", 0, "created", at(m), -1 - i)], TICKETS)


def test_updates_get_the_meeting_of_their_ticket(spark, tmp_path):
    d = f"{tmp_path}/t"
    write_file(spark, d, [("a", 1, "created", at(0), 0), ("a", None, "updated", at(1), 1), ("early", None, "updated", at(2), 2)], TICKETS)
    write_file(spark, d, [("early", 7, "created", at(3), 3), ("old", None, "updated", at(3), 4), ("never", None, "updated", at(4), 5),
                          (None, 3, "created", at(4), 6)], TICKETS)
    # Repeated rows stay (they are removed before, by topic offset); an own meeting is kept.
    write_file(spark, d, [("a", None, "updated", at(30), 7), ("a", None, "updated", at(30), 7), ("a", 9, "updated", at(31), 8)], TICKETS)
    closing(spark, d)
    known = spark.createDataFrame([("old", 42), ("old", 42), ("none", None)], "ticket_id string, meeting_id long")
    got = resolved(spark, d, known)
    assert rows_of(got, ["n", "meeting_id"]) == [(0, 1), (1, 1), (2, 7), (3, 7), (4, 42), (5, None), (7, 1), (7, 1), (8, 9)]
    # Rows that were resolved keep their event time.
    assert {r["n"]: r["ts"].minute for r in got.collect() if r["n"] < 4} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_ticket_state_expires_and_hot_ticket_is_split(spark, tmp_path):
    d = f"{tmp_path}/t"
    write_file(spark, d, [("hot", 5, "created", at(0), 0)] + [("hot", None, "updated", at(1 + i % 30), 10 + i) for i in range(300)], TICKETS)
    write_file(spark, d, [("x", 1, "created", at(3000), 1)], TICKETS)
    write_file(spark, d, [("x", 1, "created", at(3001), 2), ("hot", None, "updated", at(3002), 3)], TICKETS)
    closing(spark, d)
    got = {r["n"]: r["meeting_id"] for r in resolved(spark, d, retention="1 day").collect()}
    assert got == {0: 5, 1: 1, 2: 1, 3: None, **{10 + i: 5 for i in range(300)}}


def test_resolved_updates_feed_windows(spark, tmp_path):
    d = f"{tmp_path}/t"
    write_file(spark, d, [("a", 1, "created", at(0), 0), ("a", None, "updated", at(0.5), 1)], TICKETS)
    write_file(spark, d, [("a", None, "updated", at(20), 2), ("a", None, "updated", at(20.5), 3)], TICKETS)
    closing(spark, d)
    s = resolve_meetings(stream(spark, d, TICKETS).withWatermark("ts", "10 minutes"))
    out = s.groupBy(F.window("ts", "1 minute").alias("w"), "meeting_id").agg(F.count("n").alias("n")).select("w.start", "meeting_id", "n")
    assert text(drain(out).filter("meeting_id > 0"), ["start", "meeting_id", "n"]) == [("2024-01-01 00:00:00", "1", "2"), ("2024-01-01 00:20:00", "1", "2")]


# --- Z7 -----------------------------------------------------------------------

SEGMENTS = "meeting_id long, audio_id long, group_id long, seq long, text string, is_partial boolean, ts timestamp"
RUN = ["meeting_id", "audio_id", "group_id", "n_partials", "n_chars", "first_ts", "last_ts", "ended"]


def talk(seed, n=1500):
    """Segments in time order; meeting 1 has 70 % of them, markers and silences end runs."""
    rng = random.Random(seed)
    rows, now = [], {m: 0.0 for m in (1, 2, 3)}
    for i in range(n):
        m = 1 if rng.random() < 0.7 else rng.choice((2, 3))
        clock = max(now.values())
        now[m] = max(now[m], clock) + (rng.choice([90, 61, 60]) if rng.random() < 0.004 else 0 if rng.random() < 0.2 else rng.random() * 0.2)
        rows.append((m, rng.choice([None, m * 10, m * 10 + 1]), m, i, rng.choice([None, "", "ab", "xyz"]), rng.choice([True] * 60 + [False, None]), at(now[m])))
    return sorted(rows, key=lambda r: (r[6], r[3]))


@pytest.mark.parametrize("files", [1, 5])
def test_meeting_state_with_a_hot_meeting(spark, tmp_path, files):
    d, rows = f"{tmp_path}/s", talk(files)
    for i in range(0, len(rows), 200):
        write_file(spark, d, rows[i:i + 200], SEGMENTS)
    for i, m in enumerate(FAR):
        write_file(spark, d, [(-1, 0, 0, i, "", True, at(m))], SEGMENTS)
    got = drain(meeting_state(stream(spark, d, SEGMENTS, files), "1 hour", "5 minutes")).filter("meeting_id > 0")
    want = Z.meeting_runs(spark.createDataFrame(rows, SEGMENTS), "1 hour")
    assert text(got, RUN) == text(want, RUN) and got.count() > 10


def test_meeting_state_goes_on_after_a_restart_and_stays_small(spark, tmp_path):
    d, rows, name = f"{tmp_path}/s", talk(9, 900), "q_" + uuid.uuid4().hex[:8]
    out = meeting_state(stream(spark, d, SEGMENTS), "1 hour", "5 minutes")
    found = []
    for part in (rows[:400], rows[400:], None):
        for i in range(0, len(part or []), 200):
            write_file(spark, d, part[i:i + 200], SEGMENTS)
        for i, m in enumerate(FAR if part is None else ()):
            write_file(spark, d, [(-1, 0, 0, i, "", True, at(m))], SEGMENTS)
        sink = f"{tmp_path}/out"
        q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", stream_checkpoint(spark, name))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        last = q.lastProgress.stateOperators[-1]
        found.append(last.numRowsTotal)
    # One state row a meeting, plus its timers: never the segments.
    assert max(found) <= 3 * 20
    got = spark.read.parquet(sink).filter("meeting_id > 0")
    assert text(got, RUN) == text(Z.meeting_runs(spark.createDataFrame(rows, SEGMENTS), "1 hour"), RUN)


# --- Z2 -----------------------------------------------------------------------

EVENTS = "id long, meeting_id long, ts timestamp, status string"


def test_weekly_trends_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    week = 7 * 24 * 60
    # Around two Monday borders: the last and the first window of a week.
    times = sorted([week - 0.5, week, week + 0.5, 2 * week - 0.25] + [rng.random() * 2.5 * week for _ in range(250)])
    rows = [(i, 1 if rng.random() < 0.6 else rng.randint(2, 5), at(t), rng.choice(["TODO", "DONE", None])) for i, t in enumerate(times) for _ in range(2)]
    d = f"{tmp_path}/e"
    for i in range(0, len(rows), 120):
        write_file(spark, d, rows[i:i + 120], EVENTS)
    for m in FAR:
        write_file(spark, d, [(-1, 1, at(m), "TODO")], EVENTS)
    meetings = spark.createDataFrame([(m, m % 2, 10 * m + a) for m in range(1, 6) for a in (0, 1)], "meeting_id long, group_id long, audio_id long")

    def sides(e):
        return e.select("meeting_id", "ts"), e.select(F.col("id").cast("string").alias("ticket_id"), "meeting_id", "ts", "status", F.lit("").alias("content"))
    s = stream(spark, d, EVENTS).withWatermark("ts", "10 minutes")
    got = drain(group_trends_stream(*sides(s), meetings, "1 hour", None, None)).filter(F.col("period_start") < F.lit(at(5 * week)))
    segs, tick = sides(spark.createDataFrame(rows, EVENTS))
    want = group_trends(M.productivity_score(segs, tick, "1 hour"), M.ticket_metrics(tick, "1 hour"), meetings, "week")
    cols = ["group_id", "period_start", "period_end", "meeting_count", "distinct_meetings"]
    means = ["avg_productivity", "avg_actionable_items", "avg_status_updates"]
    shown = lambda df: text(df.select(*cols, *[F.round(m, 9).alias(m) for m in means]), cols + means)
    assert shown(got) == shown(want) and len({r["period_start"] for r in got.collect()}) == 3
    assert shown(group_trends_stream(segs, tick, meetings, "1 hour")) == shown(want)     # the same on a batch


# --- S5 with A6 ---------------------------------------------------------------

METRICS = "window_start timestamp, meeting_id long, productivity_score double"


@pytest.mark.parametrize("seed", [1, 2])
def test_hourly_pattern_does_not_depend_on_the_micro_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(at(60 * rng.randint(0, 90)), rng.randint(1, 40), rng.randint(0, 30) * 0.2) for _ in range(200)]
    target, v = f"{tmp_path}/h{seed}", 0
    parts = []
    while rows[sum(map(len, parts)):]:
        parts.append(rows[sum(map(len, parts)):][:rng.randint(1, 60)])
    for part in parts + [[]]:
        for _ in range(rng.choice([1, 2])):      # a failed batch is written again
            W.merge_metric_table(spark, K.hourly_partial(spark.createDataFrame(part, METRICS)), target, ["hour_of_day"], K.HOURLY_MERGE, v)
        v += 1
    got = K.finish_hourly(W.read_versioned(spark, target))
    want = M.hourly_pattern(spark.createDataFrame(rows, METRICS))
    shown = lambda df: rows_of(df.select("hour_of_day", F.round("avg_score", 9), "meeting_count", "distinct_meetings"))
    assert shown(got) == shown(want)
    assert len(os.listdir(f"{target}/versions")) <= W.KEEP_VERSIONS + 1     # old versions are removed


# --- Z3 -----------------------------------------------------------------------

def test_late_rows_are_counted(spark, tmp_path):
    d, table = f"{tmp_path}/e", f"{tmp_path}/progress"
    write_file(spark, d, [(1, 1, at(0), "TODO"), (2, 1, at(600), "TODO")], EVENTS)
    write_file(spark, d, [(3, 1, at(610), "TODO")], EVENTS)
    write_file(spark, d, [(4, 1, at(1), "TODO"), (5, 1, at(620), "TODO")], EVENTS)     # 4 is late
    name = "late_" + uuid.uuid4().hex[:8]
    listener = ProgressTable(spark, table)
    spark.streams.addListener(listener)
    try:
        s = stream(spark, d, EVENTS).withWatermark("ts", "10 minutes")
        drain(s.groupBy(F.window("ts", "1 minute"), "meeting_id").count(), name)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    rows = read_progress(spark, table).filter(F.col("query") == name)
    assert rows.agg(F.sum("late_rows"), F.sum("input_rows")).first() == (1, 5)


# --- sketches -----------------------------------------------------------------

def test_distinct_sketches_roll_up_within_the_stated_error(spark):
    rows = spark.range(60_000).select(F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 45 as int))").alias("ts"),
                                      (F.xxhash64("id") % 20_011).alias("user"), (F.col("id") % 3 == 0).alias("g"))
    daily = K.distinct_sketches(rows, "user", ["g"])
    assert daily.count() == 45 * 2 or daily.count() == 45
    for period in K.PERIODS:
        got = {(str(r["period_start"]), r["g"]): r["distinct_values"] for r in K.roll_up_distinct(daily, period, ["g"]).collect()}
        start = K.PERIODS[period](F.to_date("ts")).alias("p")
        want = {(str(r["p"]), r["g"]): r["n"] for r in rows.groupBy(start, "g").agg(F.count_distinct("user").alias("n")).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - n) <= 4 * 1.04 / 2 ** (K.LG_K / 2) * n + 1 for k, n in want.items())


def test_quantile_sketches_rank_error_and_nulls(spark):
    rows = spark.range(200_000).select((F.col("id") % 20).alias("day"), F.when(F.col("id") % 7 > 0, F.pow(F.rand(3), F.lit(4)) * 1000).alias("ms"),
                                       F.lit(None).cast("double").alias("none"))
    data = rows.cache()
    daily = K.quantile_sketches(data, ["ms", "none"], F.col("day"))
    got = K.finish_quantiles(daily, ["metric"], (0.1, 0.5, 0.95, 0.999)).collect()
    assert [r["metric"] for r in got] == ["ms"]
    n = data.filter("ms IS NOT NULL").count()
    assert got[0]["n"] == n and got[0]["max"] == data.agg(F.max("ms")).first()[0]
    for p, name in ((0.1, "p10"), (0.5, "p50"), (0.95, "p95"), (0.999, "p100")):
        rank = data.filter(F.col("ms") <= got[0][name]).count() / n
        assert abs(rank - p) < 0.002
    data.unpersist()


def test_quantile_sketches_on_a_stream(spark, tmp_path):
    d, schema = f"{tmp_path}/l", "ts timestamp, ms double"
    rows = [(at(i % 50), float(i * 37 % 1000)) for i in range(1000)]
    for part in (rows[:1000:2], rows[1::2], [(at(FAR[0]), 0.0)], [(at(FAR[1]), 0.0)]):
        write_file(spark, d, sorted(part), schema)
    s = stream(spark, d, schema).withWatermark("ts", "2 hours")
    got = drain(K.quantile_sketches(s, ["ms"], F.window("ts", "1 hour"))).filter(F.col("window.start") < F.lit(at(600)))
    r = K.finish_quantiles(got).first()
    assert (r["n"], r["p50"], r["p95"], r["max"]) == (1000, 499.0, 949.0, 999.0)


def test_top_terms_sketch_with_separated_counts(spark):
    """More terms than counters: terms that stand apart are found with their counts."""
    heavy = [(f"h{i}", 3000 - 300 * i) for i in range(5)]
    terms = spark.createDataFrame(heavy, "term string, n int").select("term", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    terms = terms.unionByName(spark.range(20_000).select(F.concat(F.lit("r"), F.col("id") % 9000).alias("term"), F.col("id").cast("int").alias("i")))
    terms = terms.withColumn("day", F.col("i") % 10)
    exact = rows_of(K.top_terms_per_window(terms, F.lit("all"), 5), ["rank", "term", "n"])
    merged = K.term_sketches(terms, F.col("day"), items=2048).withColumn("all", F.lit(1))
    got = rows_of(K.top_of_sketches(merged, ["all"], 5, 2048), ["rank", "term", "n"])
    assert [g[:2] for g in got] == [e[:2] for e in exact] == [(i + 1, f"h{i}") for i in range(5)]
    assert all(0 <= g[2] - e[2] <= 100 for g, e in zip(got, exact, strict=True))
