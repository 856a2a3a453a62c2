"""Windowed ticket and meeting metrics.

Every aggregate is a ``groupBy().agg()`` of built-in functions, so Spark
combines partial aggregates map-side before the shuffle: a meeting that holds
a third of all rows costs one partial row per input partition, not a third of
the shuffle. Functions take streaming or batch frames alike; watermarks are
applied only to streams (they are a no-op on batch and require TIMESTAMP).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agendum.operators.relational import meeting_groups
from agendum.functions.expressions import (DEFAULT_BLOCKER_PATTERN, is_actionable,
                                           mentions_blocker, score)


BANDS = 256           # bands of the number line per power of two (latency percentiles)
BAND_SHIFT = 1100 * BANDS   # keeps band numbers of small values positive


def _watermarked(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    return df.withWatermark(ts, delay) if (delay and df.isStreaming) else df


def flatten_window(df: DataFrame, col: str = "window") -> DataFrame:
    """``window`` struct → ``window_start, window_end`` first, rest after."""
    rest = [c for c in df.columns if c != col]
    return df.select(F.col(f"{col}.start").alias("window_start"),
                     F.col(f"{col}.end").alias("window_end"), *rest)


def ticket_counts(tickets: DataFrame, window_duration: str = "1 minute",
                  watermark: str | None = "10 minutes", ts: str = "ts",
                  flatten: bool = True) -> DataFrame:
    """A1: tickets and actionable tickets per (window, meeting)."""
    out = (_watermarked(tickets, ts, watermark)
           .groupBy(F.window(ts, window_duration).alias("window"), "meeting_id")
           .agg(F.count("ticket_id").alias("ticket_count"),
                F.sum(is_actionable("status")).cast("long").alias("actionable_tickets")))
    return flatten_window(out) if flatten else out


def segment_counts(transcripts: DataFrame, window_duration: str = "1 minute",
                   watermark: str | None = "2 minutes", ts: str = "ts") -> DataFrame:
    """Transcript segments per (window, meeting); the reference groups the
    transcript stream here but never aggregates it."""
    return (_watermarked(transcripts, ts, watermark)
            .groupBy(F.window(ts, window_duration).alias("window"), "meeting_id")
            .agg(F.count(F.lit(1)).alias("segment_count")))


def productivity_score(transcripts: DataFrame, tickets: DataFrame,
                       window_duration: str = "1 minute", ts: str = "ts",
                       transcript_watermark: str | None = "2 minutes",
                       ticket_watermark: str | None = "10 minutes") -> DataFrame:
    """A2 + J1: transcript windows joined with ticket windows on
    (window, meeting); score = 0.6 * actionable + 0.4 * tickets.

    Both sides are aggregated on the join key, so the join reads two
    co-partitioned outputs (no extra exchange); the join keeps the ``window``
    struct until after the join to preserve that partitioning.
    """
    seg = segment_counts(transcripts, window_duration, transcript_watermark, ts)
    tck = ticket_counts(tickets, window_duration, ticket_watermark, ts, flatten=False)
    joined = seg.join(tck, ["window", "meeting_id"], "inner")
    out = (joined
           .withColumn("productivity_score", score("actionable_tickets", "ticket_count"))
           .withColumn("productivity_ratio",
                       F.col("productivity_score") / F.col("ticket_count").cast("double")))
    return flatten_window(out)


def ticket_metrics(tickets: DataFrame, window_duration: str = "1 minute",
                   blocker_pattern: str = DEFAULT_BLOCKER_PATTERN,
                   watermark: str | None = "2 minutes", ts: str = "ts",
                   flatten: bool = True) -> DataFrame:
    """A3: actionable items, status updates (non-null statuses) and blocker
    mentions per (window, meeting)."""
    out = (_watermarked(tickets, ts, watermark)
           .groupBy(F.window(ts, window_duration).alias("window"), "meeting_id")
           .agg(F.sum(is_actionable("status")).cast("long").alias("actionable_items_count"),
                F.count("status").alias("status_updates_count"),
                F.sum(mentions_blocker("content", blocker_pattern)).cast("long")
                 .alias("blockers_mentioned")))
    return flatten_window(out) if flatten else out


def blocker_alerts(metrics: DataFrame, min_count: int = 1) -> DataFrame:
    """Metric windows with at least ``min_count`` blocker mentions."""
    return metrics.filter(F.col("blockers_mentioned") >= F.lit(min_count))


def hourly_pattern(metrics: DataFrame) -> DataFrame:
    """Mean score and number of metric rows per hour of window start.
    ``meeting_count`` counts rows like the reference; ``distinct_meetings``
    counts meetings."""
    return (metrics.groupBy(F.hour("window_start").alias("hour_of_day"))
            .agg(F.avg("productivity_score").alias("avg_score"),
                 F.count("meeting_id").alias("meeting_count"),
                 F.count_distinct("meeting_id").alias("distinct_meetings")))


def workflow_times(status_events: DataFrame, status: str = "status", ts: str = "ts",
                   created_at: str = "created_at", watermark: str | None = "1 day") -> DataFrame:
    """Per status, number of events and mean seconds since creation."""
    return (_watermarked(status_events, ts, watermark)
            .groupBy(F.col(status).alias("status"))
            .agg(F.count("ticket_id").alias("ticket_count"),
                 F.avg(F.unix_timestamp(F.col(ts)) - F.unix_timestamp(F.col(created_at)))
                  .alias("avg_time_in_status")))


def with_group(metrics: DataFrame, meetings: DataFrame) -> DataFrame:
    """Attach group_id. The meeting table may hold one row per audio, so it
    is reduced to distinct (meeting, group) first; otherwise metrics fan out."""
    return metrics.join(meeting_groups(meetings), "meeting_id", "inner")


def completion_rate(tickets: DataFrame, meetings: DataFrame, ts: str = "created_at") -> DataFrame:
    """Share of DONE tickets per group and Monday-based week.

    Tickets are first reduced per (meeting, week) so the join with the meeting
    table carries partial counts, not ticket rows."""
    week = F.window(F.col(ts), "7 days", "7 days", "4 days")
    per_meeting = (tickets.groupBy("meeting_id", week.start.alias("week_start"))
                   .agg(F.count(F.lit(1)).alias("n"),
                        F.sum(F.when(F.col("status") == "DONE", 1).otherwise(0)).alias("done")))
    return (with_group(per_meeting, meetings)
            .groupBy("group_id", "week_start")
            .agg(F.sum("n").alias("ticket_count"), F.sum("done").cast("long").alias("done_count"))
            .withColumn("completion_rate",
                        F.col("done_count").cast("double") / F.col("ticket_count").cast("double")))


def board_counts(tickets: DataFrame) -> DataFrame:
    """Tickets per status plus an ``All`` row (ROLLUP)."""
    return (tickets.rollup("status").agg(F.count(F.lit(1)).alias("ticket_count"),
                                         F.grouping("status").alias("g"))
            .select(F.when(F.col("g") == 1, F.lit("All")).otherwise(F.col("status")).alias("status"),
                    "ticket_count"))


def daily_activity(transcripts: DataFrame, tickets: DataFrame,
                   transcript_ts: str = "ts", ticket_ts: str = "created_at") -> DataFrame:
    """Distinct meetings and tickets per calendar date (full outer join
    of two per-date aggregates)."""
    m = (transcripts.groupBy(F.to_date(transcript_ts).alias("activity_date"))
         .agg(F.count_distinct("meeting_id").alias("meetings")))
    t = (tickets.groupBy(F.to_date(ticket_ts).alias("activity_date"))
         .agg(F.count(F.lit(1)).alias("tickets")))
    return (m.join(t, "activity_date", "full_outer")
            .select("activity_date",
                    F.coalesce("meetings", F.lit(0)).alias("meetings"),
                    F.coalesce("tickets", F.lit(0)).alias("tickets")))


def meeting_summary(transcripts: DataFrame, ts: str = "ts", speaker: str | None = None) -> DataFrame:
    """Date, start, end, duration, segments and speakers per meeting."""
    aggs = [F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"),
            F.count(F.lit(1)).alias("segment_count")]
    if speaker:
        aggs.append(F.count_distinct(speaker).alias("participants"))
    return (transcripts.groupBy("meeting_id").agg(*aggs)
            .withColumn("meeting_date", F.to_date("started_at"))
            .withColumn("duration_sec",
                        F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")))


def kpi_totals(transcripts: DataFrame, tickets: DataFrame, members: DataFrame,
               ts: str = "ts") -> DataFrame:
    """Dashboard totals as (kpi, value) rows. Each total is its own
    aggregate; rows are unioned, so no cross join is needed."""
    per_meeting = meeting_summary(transcripts, ts)
    parts = [
        per_meeting.agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("kpi", F.lit("meetings")),
        tickets.agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("kpi", F.lit("tickets")),
        members.agg(F.count_distinct("user_id").cast("double").alias("value")).withColumn("kpi", F.lit("participants")),
        per_meeting.agg((F.avg("duration_sec") / 60.0).alias("value")).withColumn("kpi", F.lit("avg_duration_min")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kpi", "value")


def latency_stats(latency: DataFrame, metrics=("kafka_delivery_ms", "processing_ms", "total_ms"),
                  probs=(0.5, 0.95)) -> DataFrame:
    """Count, mean, exact percentiles (linear interpolation, like
    ``quantile_cont``) and max of each latency column.

    The values are reduced once to a (metric, value, count) histogram (map-side
    combine). Values fall into fixed bands of the number line (``BANDS`` per
    power of two), whose counts are a small table; the prefix sums of that table
    tell which bands hold the target ranks, and only the histogram rows of those
    bands are ranked. No task holds all values of a metric.
    """
    long = latency.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics
    ])).alias("r")).select("r.metric", "r.v").filter(F.col("v").isNotNull())
    size = F.floor(F.log2(F.abs("v")) * BANDS)
    band = F.when(F.col("v") == 0, F.lit(0)).otherwise(F.signum("v").cast("long") * (size + BAND_SHIFT)).cast("long")
    hist = long.groupBy("metric", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("band", band)
    bands = hist.groupBy("metric", "band").agg(F.sum("c").alias("c"), F.sum(F.col("v") * F.col("c")).alias("s"), F.max("v").alias("top"))
    # One row per metric and band: a table of fixed size, whatever the input.
    w = Window.partitionBy("metric").orderBy("band")
    bands = bands.withColumn("end", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    basic = bands.groupBy("metric").agg(F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("avg"), F.max("top").alias("max"))
    names = [f"p{int(round(p * 100))}" for p in probs]
    h = (F.col("n") - 1) * F.col("t.p")
    # Two 0-based positions around (n-1)*p for every p.
    targets = (basic.select("metric", "n", F.explode(F.array(*[
        F.struct(F.lit(nm).alias("name"), F.lit(float(p)).alias("p")) for nm, p in zip(names, probs)
    ])).alias("t")).select("metric", "t.name", (h - F.floor(h)).alias("frac"), F.posexplode(F.array(F.floor(h), F.ceil(h))).alias("side", "i")))
    start = F.col("end") - F.col("c")
    wanted = (bands.join(targets, "metric").filter((start <= F.col("i")) & (F.col("i") < F.col("end")))
              .select("metric", "band", "name", "frac", "side", (F.col("i") - start).alias("i")))
    inside = Window.partitionBy("metric", "band").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (hist.join(wanted.select("metric", "band").distinct(), ["metric", "band"], "left_semi")
              .withColumn("hi", F.sum("c").over(inside)))
    picked = (ranked.join(wanted, ["metric", "band"]).filter((F.col("hi") - F.col("c") <= F.col("i")) & (F.col("i") < F.col("hi")))
              .groupBy("metric", "name", "frac")
              .agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("v0"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("v1"))
              .select("metric", "name", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac")).alias("q")))
    quant = picked.groupBy("metric").pivot("name", names).agg(F.first("q"))
    return basic.join(quant, "metric", "left")


def meeting_efficiency(transcripts: DataFrame, tickets: DataFrame, ts: str = "ts") -> DataFrame:
    """Actionable tickets per transcript segment and per minute."""
    summ = meeting_summary(transcripts, ts).select("meeting_id", "segment_count", "duration_sec")
    act = tickets.groupBy("meeting_id").agg(
        F.sum(is_actionable("status")).cast("long").alias("actionable_tickets"))
    return (summ.join(act, "meeting_id", "inner")
            .withColumn("actionable_per_segment",
                        F.try_divide(F.col("actionable_tickets").cast("double"), F.col("segment_count").cast("double")))
            .withColumn("actionable_per_minute",
                        F.try_divide(F.col("actionable_tickets").cast("double") * 60.0,
                                     F.col("duration_sec").cast("double"))))
