"""Stream-shaped operators (Z4, Z6, Z7, Z8, J9) with batch twins.

Each function accepts a streaming or a batch frame. Streams need event time
as TIMESTAMP (``withWatermark`` refuses TIMESTAMP_NTZ): use ``to_event_time``
on the stream path. Batch twins are written to stay parallel when one meeting
holds most rows (ordered steps go through ``functions.windows``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agendum.functions.windows import segmented_runs


def to_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Stream path: TIMESTAMP_NTZ → TIMESTAMP (session time zone is UTC)."""
    return df.withColumn(ts, F.to_timestamp(F.col(ts).cast("string")))


def watermarked(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    """Apply the watermark on streams; ``None`` means the stream already
    carries one from upstream (Spark refuses to redefine it)."""
    return df.withWatermark(ts, delay) if (delay and df.isStreaming) else df


def _interval(spec: str):
    return F.expr(f"INTERVAL {spec}")


def dedup_events(df: DataFrame, keys: Sequence[str] = ("event_id",), ts: str = "ts",
                 watermark: str = "10 minutes") -> DataFrame:
    """Drop repeated deliveries of one event. Streams keep a key only
    within the watermark (bounded state); batch is a plain dropDuplicates."""
    if df.isStreaming:
        return watermarked(df, ts, watermark).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))


def save_windows(segments: DataFrame, window_duration: str = "30 seconds", key: str = "meeting_id",
                 ts: str = "ts", seq: str = "seq", text: str = "text", is_partial: str = "is_partial",
                 watermark: str = "2 minutes") -> DataFrame:
    """The 30-second save: per meeting and window, the partial texts in
    order joined by a space, their number, and whether the window holds the
    meeting's final marker. Empty texts (the marker itself) add no text."""
    df = watermarked(segments, ts, watermark)
    nonempty = F.when(F.col(text).isNotNull() & (F.col(text) != ""),
                      F.struct(F.col(ts).alias("t"), F.col(seq).alias("s"), F.col(text).alias("x")))
    g = df.groupBy(F.window(ts, window_duration).alias("w"), key).agg(
        F.array_sort(F.collect_list(nonempty)).alias("__parts"),
        F.count(F.lit(1)).alias("n_segments"),
        F.max((~F.col(is_partial)).cast("int")).alias("__final"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key,
                    "n_segments", F.array_join(F.transform("__parts", lambda p: p["x"]), " ").alias("text"),
                    (F.col("__final") == 1).alias("is_final"))


def meeting_sessions(segments: DataFrame, gap: str = "6 hours", key: str = "meeting_id",
                     ts: str = "ts", tiebreak: Sequence[str] = ("seq",),
                     watermark: str = "2 minutes") -> DataFrame:
    """A meeting ends after more than ``gap`` of silence. Session =
    [first event, last event + gap), like ``session_window`` (an event exactly
    ``gap`` after the previous one still joins its session).

    Streams use ``session_window``. The batch twin numbers sessions with a
    gaps-and-islands pass (previous event time, then a running count of
    session starts) computed per day segment, so a meeting with most of the
    events does not become one task."""
    if segments.isStreaming:
        g = (watermarked(segments, ts, watermark)
             .groupBy(F.session_window(ts, gap).alias("s"), key)
             .agg(F.count(F.lit(1)).alias("n_events")))
        return g.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                        "n_events")
    order = [ts, *tiebreak]
    gap_iv = _interval(gap)
    sess = segmented_runs(segments.select(key, *order), [key], order, [ts],
                          lambda p, c: c[ts] > p[ts] + gap_iv, F.date_trunc("day", F.col(ts)), "__session")
    g = sess.groupBy(key, "__session").agg(F.min(ts).alias("session_start"), F.max(ts).alias("__last"),
                                            F.count(F.lit(1)).alias("n_events"))
    return g.select(key, "session_start", (F.col("__last") + _interval(gap)).alias("session_end"), "n_events")


def await_transcripts(requests: DataFrame, transcripts: DataFrame, bound: str = "30 seconds",
                      bound_seconds: int = 30, key: str = "meeting_id", ts: str = "ts",
                      request_id: str = "request_id", watermark: str = "2 minutes") -> DataFrame:
    """For every transcript request, the first transcript of the same
    meeting at or after it and within ``bound``; none means timed out.

    Batch twin: a range join made an equi-join on (meeting, time bucket of
    ``bound`` width): a request looks only at its own and the next bucket,
    so a busy meeting is not compared all-against-all. Streams use Spark's
    interval join with watermarks on both sides (left outer, append mode), then
    one row per request: the first match, or none, once the watermark has
    passed the request's bound."""
    if requests.isStreaming:
        r = watermarked(requests, ts, watermark).select(
            request_id, F.col(key).alias("__rk"), F.col(ts).alias("requested_at"))
        t = watermarked(transcripts, ts, watermark).select(
            F.col(key).alias("__tk"), F.col(ts).alias("transcript_at"))
        cond = ((F.col("__rk") == F.col("__tk")) & (F.col("transcript_at") >= F.col("requested_at"))
                & (F.col("transcript_at") <= F.col("requested_at") + _interval(bound)))
        j = r.join(t, cond, "left_outer")
        g = (j.groupBy(F.window("requested_at", f"{bound_seconds} seconds").alias("__w"), request_id, F.col("__rk").alias(key))
             .agg(F.min("requested_at").alias("requested_at"), F.min("transcript_at").alias("first_transcript_at")))
        return g.select(request_id, key, "requested_at", "first_transcript_at",
                        F.col("first_transcript_at").isNull().alias("timed_out"))
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c)) / F.lit(bound_seconds))
    r = requests.select(request_id, key, F.col(ts).alias("requested_at"))
    r2 = r.withColumn("__b", F.explode(F.array(bucket("requested_at"), bucket("requested_at") + 1)))
    t2 = transcripts.select(key, F.col(ts).alias("__t")).withColumn("__b", bucket("__t"))
    pairs = (r2.join(t2, [key, "__b"])
               .filter((F.col("__t") >= F.col("requested_at"))
                       & (F.col("__t") <= F.col("requested_at") + _interval(bound))))
    first = pairs.groupBy(request_id).agg(F.min("__t").alias("first_transcript_at"))
    return (r.join(first, request_id, "left")
             .withColumn("timed_out", F.col("first_transcript_at").isNull()))


def meeting_runs(segments: DataFrame, timeout: str = "1 hour", key: str = "meeting_id",
                 ts: str = "ts", seq: str = "seq", text: str = "text",
                 is_partial: str = "is_partial") -> DataFrame:
    """Z7 batch twin: one row per meeting run as the per-meeting state emits
    it. A run ends at a final marker (``is_partial`` false) or when the
    meeting is silent for more than ``timeout``; the row holds metadata,
    counts, first/last time and whether a final marker ended it.

    Run numbers come from the previous row (segmented lag) and a running
    count of run starts, so a long meeting is still split over many tasks."""
    order = [ts, seq]
    base = segments.withColumn("__final", ~F.coalesce(F.col(is_partial), F.lit(False)))
    timeout_iv = _interval(timeout)
    runs = segmented_runs(base, [key], order, [ts, "__final"],
                          lambda p, c: p["__final"] | (c[ts] > p[ts] + timeout_iv),
                          F.date_trunc("day", F.col(ts)), "run")
    return runs.groupBy(key, "run").agg(
        F.min("audio_id").alias("audio_id"), F.min("group_id").alias("group_id"),
        F.sum((~F.col("__final")).cast("int")).cast("long").alias("n_partials"),
        F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("n_chars"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.max(F.col("__final").cast("int")).cast("boolean").alias("ended"))
