"""Group trends and comparisons over periods.

All windows here run over already aggregated rows (one per group and period,
or per KPI and period), so their partitions are small by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agendum.functions.expressions import is_actionable, score
from agendum.operators.metrics import segment_counts, with_group


def period_bounds(ts: str, period: str) -> tuple:
    """(start, end) columns of a Monday-based week or a calendar month."""
    c = F.col(ts)
    if period == "week":
        w = F.window(c, "7 days", "7 days", "4 days")
        return w.start, w.end
    if period == "month":
        start = F.to_timestamp_ntz(F.trunc(c, "month"))
        return start, F.to_timestamp_ntz(F.add_months(F.trunc(c, "month"), 1))
    raise ValueError(period)


def group_trends(realtime: DataFrame, ticket_metrics: DataFrame, meetings: DataFrame,
                 period: str = "week") -> DataFrame:
    """Per group and period: mean productivity, mean actionable items,
    mean status updates and the number of metric rows (``meeting_count``, as
    the reference counts) plus distinct meetings. Real-time and ticket metrics
    are joined on (meeting, window); joining on the meeting alone would
    multiply windows. All groups in one job."""
    rt = realtime.select("meeting_id", "window_start", "window_end", "productivity_score")
    tm = ticket_metrics.select("meeting_id", "window_start", "window_end",
                               "actionable_items_count", "status_updates_count")
    j = with_group(rt.join(tm, ["meeting_id", "window_start", "window_end"], "inner"), meetings)
    start, end = period_bounds("window_start", period)
    return (j.groupBy("group_id", start.alias("period_start"), end.alias("period_end"))
            .agg(F.avg("productivity_score").alias("avg_productivity"),
                 F.avg("actionable_items_count").alias("avg_actionable_items"),
                 F.avg("status_updates_count").alias("avg_status_updates"),
                 F.count("meeting_id").alias("meeting_count"),
                 F.count_distinct("meeting_id").alias("distinct_meetings")))


def group_trends_stream(transcripts: DataFrame, tickets: DataFrame, meetings: DataFrame, window_duration: str = "1 minute",
                        transcript_watermark: str | None = "2 minutes", ticket_watermark: str | None = "10 minutes",
                        ts: str = "ts") -> DataFrame:
    """Z2 with A8: weekly group trends of the short metric windows, on a stream.

    Aggregates are chained in append mode: short windows per meeting, their join,
    then by ``window_time`` weekly (Monday-based) sums per meeting, then per group.
    The middle step makes the distinct meetings exact and lets a group with most of
    the meetings be summed by many tasks. Sums are exact decimals, so the result
    doesn't depend on the micro-batches. Rows as ``group_trends(..., "week")``."""
    short = F.window(ts, window_duration).alias("window")
    seg = segment_counts(transcripts, window_duration, transcript_watermark, ts)
    if ticket_watermark and tickets.isStreaming:
        tickets = tickets.withWatermark(ts, ticket_watermark)
    tck = tickets.groupBy(short, "meeting_id").agg(
        F.count("ticket_id").alias("ticket_count"), F.sum(is_actionable("status")).cast("long").alias("actionable_tickets"),
        F.count("status").alias("status_updates_count"))
    rows = with_group(seg.join(tck, ["window", "meeting_id"], "inner"), meetings)
    exact = score("actionable_tickets", "ticket_count").cast("decimal(28,6)")
    per_meeting = (rows.groupBy(F.window(F.window_time("window"), "7 days", "7 days", "4 days").alias("week"), "group_id", "meeting_id")
                   .agg(F.sum(exact).alias("score"), F.sum("actionable_tickets").alias("actionable"),
                        F.sum("status_updates_count").alias("updates"), F.count("meeting_id").alias("n")))
    mean = lambda c: F.col(c).cast("double") / F.col("meeting_count")
    out = (per_meeting.groupBy("week", "group_id")
           .agg(F.sum("score").alias("score"), F.sum("actionable").alias("actionable"), F.sum("updates").alias("updates"),
                F.sum("n").alias("meeting_count"), F.count("meeting_id").alias("distinct_meetings")))
    return out.select("group_id", F.col("week.start").alias("period_start"), F.col("week.end").alias("period_end"),
                      mean("score").alias("avg_productivity"), mean("actionable").alias("avg_actionable_items"),
                      mean("updates").alias("avg_status_updates"), "meeting_count", "distinct_meetings")


def kpi_series(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Daily KPI values in long form (kpi, period, value)."""
    daily = events.groupBy(F.to_date(ts).alias("period")).agg(
        F.count_distinct("meeting_id").cast("double").alias("meetings"),
        F.count(F.lit(1)).cast("double").alias("tickets"),
        F.sum(F.when(F.col("status") != "TODO", 1).otherwise(0)).cast("double").alias("actionable"))
    return daily.select("period", F.explode(F.array(
        *[F.struct(F.lit(k).alias("kpi"), F.col(k).alias("value")) for k in ("meetings", "tickets", "actionable")]
    )).alias("k")).select("k.kpi", "period", "k.value")


def kpi_change(series: DataFrame) -> DataFrame:
    """Period-over-period change of each KPI, in percent."""
    w = Window.partitionBy("kpi").orderBy("period")
    prev = F.lag("value").over(w)
    return (series.withColumn("prev_value", prev)
            .withColumn("pct_change",
                        F.when(F.col("prev_value") != 0,
                               (F.col("value") - F.col("prev_value")) / F.col("prev_value") * 100.0)))


def rank_groups(trends: DataFrame) -> DataFrame:
    """Rank of each group within its period by mean productivity."""
    w = Window.partitionBy("period_start").orderBy(F.col("avg_productivity").desc())
    return trends.select("group_id", "period_start", "avg_productivity",
                         F.rank().over(w).alias("rank"))


def productivity_decline(trends: DataFrame) -> DataFrame:
    """Periods whose mean productivity fell below the group's previous
    period, with the change of both score inputs and of the row count."""
    w = Window.partitionBy("group_id").orderBy("period_start")
    t = (trends.withColumn("prev_productivity", F.lag("avg_productivity").over(w))
               .withColumn("prev_actionable", F.lag("avg_actionable_items").over(w))
               .withColumn("prev_meetings", F.lag("meeting_count").over(w)))
    return (t.filter(F.col("avg_productivity") < F.col("prev_productivity"))
             .select("group_id", "period_start", "avg_productivity", "prev_productivity",
                     (F.col("avg_productivity") - F.col("prev_productivity")).alias("delta_productivity"),
                     (F.col("avg_actionable_items") - F.col("prev_actionable")).alias("delta_actionable"),
                     (F.col("meeting_count") - F.col("prev_meetings")).alias("delta_meetings")))


def best_hours(hourly: DataFrame, k: int = 3) -> DataFrame:
    """L4: the k hours with the highest mean score (hour breaks ties)."""
    return hourly.orderBy(F.col("avg_score").desc(), F.col("hour_of_day")).limit(k)
