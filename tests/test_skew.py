"""The skew-safe forms equal the plain (one-task-per-key) forms, on data where
one key holds most rows."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from agendum.functions.windows import segmented_running_count, segmented_shift
from agendum.operators import history as H
from agendum.operators import text as X
from agendum.streaming import operators as Z
from tests.conftest import rows_of


def hot_rows(n=600, seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        key = 1 if rnd.random() < 0.7 else rnd.randint(2, 6)       # key 1 holds ~70 %
        ts = base + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 5))
        out.append((key, ts, i, rnd.choice(["TODO", "IN_PROGRESS", "DONE"]), rnd.random() < 0.2))
    return out


def frame(spark):
    return spark.createDataFrame(hot_rows(), "k long, ts timestamp_ntz, seq long, status string, flag boolean")


def test_segmented_lag_and_lead_equal_plain_window(spark):
    df = frame(spark)
    w = Window.partitionBy("k").orderBy("ts", "seq")
    seg = F.date_trunc("day", F.col("ts"))
    for direction, fn in (("lag", F.lag), ("lead", F.lead)):
        got = segmented_shift(df, ["k"], ["ts", "seq"], ["status", "ts"], seg, direction, prefix="o_")
        want = df.withColumn("o_status", fn("status").over(w)).withColumn("o_ts", fn("ts").over(w))
        cols = ["k", "seq", "o_status", "o_ts"]
        assert rows_of(got, cols) == rows_of(want, cols)


def test_segmented_running_count_equals_plain(spark):
    df = frame(spark)
    w = Window.partitionBy("k").orderBy("ts", "seq")
    got = segmented_running_count(df, ["k"], ["ts", "seq"], F.col("flag"), F.date_trunc("day", F.col("ts")),
                                  rank_name="r", before_name="b")
    want = (df.withColumn("r", F.row_number().over(w).cast("long"))
              .withColumn("b", F.coalesce(F.sum(F.col("flag").cast("long"))
                                          .over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    assert rows_of(got, ["k", "seq", "r", "b"]) == rows_of(want, ["k", "seq", "r", "b"])


def simulate_buffer(sizes, buffer_size, chunk_size):
    """The buffer rule, step by step: append; flush at ``buffer_size`` chunks
    or on a short chunk."""
    groups, cur = [], []
    for seq, n in sizes:
        cur.append((seq, n))
        if len(cur) >= buffer_size or n < chunk_size:
            groups.append((cur[0][0], cur[-1][0], len(cur), "full" if len(cur) == buffer_size else "short"))
            cur = []
    if cur:
        groups.append((cur[0][0], cur[-1][0], len(cur), "open"))
    return groups


def test_chunk_flush_groups_equal_simulation(spark):
    rnd = random.Random(3)
    data, want = [], []
    for meeting, n in ((1, 400), (2, 37), (3, 5)):
        sizes = [(s, 32768 if rnd.random() < 0.8 else rnd.randint(1, 32767)) for s in range(n)]
        data += [(meeting, s, b) for s, b in sizes]
        want += [(meeting, *g) for g in simulate_buffer(sizes, 5, 32768)]
    df = spark.createDataFrame(data, "meeting_id long, seq long, n_bytes long")
    got = rows_of(H.chunk_flush_groups(df, 5, 32768, seq_bucket=16),
                  ["meeting_id", "first_seq", "last_seq", "n_chunks", "flush_reason"])
    assert got == sorted(want)


def test_batch_sessions_equal_session_window(spark):
    df = frame(spark).select(F.col("k").alias("meeting_id"), "ts", "seq")
    got = Z.meeting_sessions(df, "2 hours")
    want = (df.groupBy(F.session_window("ts", "2 hours").alias("s"), "meeting_id")
              .agg(F.count(F.lit(1)).alias("n_events"))
              .select("meeting_id", F.col("s.start").alias("session_start"),
                      F.col("s.end").alias("session_end"), "n_events"))
    cols = ["meeting_id", "session_start", "session_end", "n_events"]
    assert rows_of(got, cols) == rows_of(want, cols)


def test_bucketed_timeout_join_equals_range_join(spark):
    df = frame(spark)
    req = df.filter("flag").select(F.col("seq").alias("request_id"), F.col("k").alias("meeting_id"), "ts")
    arr = df.filter("not flag").select(F.col("k").alias("meeting_id"), "ts")
    got = Z.await_transcripts(req, arr, "3 hours", 3 * 3600)
    r, a = req.alias("r"), arr.alias("a")
    want = (r.join(a, (F.col("r.meeting_id") == F.col("a.meeting_id")) & (F.col("a.ts") >= F.col("r.ts"))
                   & (F.col("a.ts") <= F.col("r.ts") + F.expr("INTERVAL 3 HOURS")), "left")
              .groupBy("request_id").agg(F.min("a.ts").alias("first_transcript_at")))
    assert rows_of(got, ["request_id", "first_transcript_at"]) == rows_of(want)


def test_prefix_filtered_match_equals_brute_force(spark):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(40)] + ["the", "a", "of"]
    weights = [1] * 40 + [30, 30, 30]

    def sentence():
        return " ".join(rnd.choices(vocab, weights, k=rnd.randint(1, 9)))
    mentions = spark.createDataFrame([(i, sentence()) for i in range(150)], "mention_id long, text string")
    tickets = spark.createDataFrame([(i, sentence()) for i in range(60)], "ticket_id long, title string")
    for th in (0.3, 0.5, 0.7):
        got = rows_of(X.match_titles(mentions, tickets, th), ["mention_id", "ticket_id"])
        m = {r.mention_id: set(r.text.lower().split()) for r in mentions.collect()}
        t = {r.ticket_id: set(r.title.lower().split()) for r in tickets.collect()}
        want = sorted((i, j) for i, a in m.items() for j, b in t.items()
                      if a and b and len(a & b) / len(a | b) >= th)
        assert got == want
