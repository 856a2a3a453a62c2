"""Ticket status history: derivation, checks, dwell times and per-ticket /
per-meeting change patterns (W2-W4, W8, A4, A5).

Ordered per-key steps use ``functions.windows`` so a ticket or meeting with a
third of all rows is still processed by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agendum.functions.expressions import mentions_blocker
from agendum.functions.windows import segmented_running_count, segmented_shift

# --- fixed values -----------------------------------------------------------
# Moves an automatic (model-driven) status change may make.
ALLOWED_TRANSITIONS = (("TODO", "IN_PROGRESS"), ("TODO", "DONE"), ("IN_PROGRESS", "DONE"))
# ---------------------------------------------------------------------------


def day_segment(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts))


def derive_history(events: DataFrame, key: str = "ticket_id", ts: str = "ts",
                   status: str = "status", tiebreak: Sequence[str] = (),
                   segment: Column | None = None) -> DataFrame:
    """One row per status change: ``old_status`` (NULL for the first
    event) and ``new_status``; events that repeat the current status are
    removed. Order per ticket is (ts, *tiebreak), which must be total."""
    order = [ts, *tiebreak]
    seg = segment if segment is not None else day_segment(ts)
    shifted = segmented_shift(events, [key], order, [status], seg, "lag", prefix="__old_")
    return (shifted.filter(~F.col(f"__old_{status}").eqNullSafe(F.col(status)))
                   .withColumnRenamed(f"__old_{status}", "old_status")
                   .withColumnRenamed(status, "new_status")
                   .withColumnRenamed(ts, "changed_at"))


def transition_allowed(old: str | Column, new: str | Column,
                       allowed: Iterable[tuple[str, str]] = ALLOWED_TRANSITIONS) -> Column:
    o = F.col(old) if isinstance(old, str) else old
    n = F.col(new) if isinstance(new, str) else new
    cond = F.lit(False)
    for a, b in allowed:
        cond = cond | ((o == F.lit(a)) & (n == F.lit(b)))
    return cond


def check_transitions(history: DataFrame,
                      allowed: Iterable[tuple[str, str]] = ALLOWED_TRANSITIONS) -> DataFrame:
    """Changes (with a previous status) that are not an allowed move.
    The allowed set is a constant, so the check is an expression, not a join."""
    return history.filter(F.col("old_status").isNotNull()
                          & ~F.coalesce(transition_allowed("old_status", "new_status", allowed), F.lit(False)))


def status_dwell(history: DataFrame, key: str = "ticket_id", ts: str = "changed_at",
                 tiebreak: Sequence[str] = (), segment: Column | None = None) -> DataFrame:
    """Seconds spent in each status until the ticket's next change, mean
    per status; the status with the largest mean is flagged as bottleneck."""
    order = [ts, *tiebreak]
    seg = segment if segment is not None else day_segment(ts)
    nxt = segmented_shift(history, [key], order, [ts], seg, "lead", prefix="__next_")
    dwell = nxt.filter(F.col(f"__next_{ts}").isNotNull()).select(
        F.col("new_status").alias("status"),
        (F.unix_timestamp(F.col(f"__next_{ts}")) - F.unix_timestamp(F.col(ts))).alias("dwell_sec"))
    per_status = dwell.groupBy("status").agg(F.count(F.lit(1)).alias("transitions"),
                                             F.avg("dwell_sec").alias("avg_dwell_sec"))
    # One row per status value: ranking them needs no partitioning.
    return per_status.withColumn(
        "is_bottleneck", F.rank().over(Window.orderBy(F.col("avg_dwell_sec").desc())) == 1)


def chunk_flush_groups(chunks: DataFrame, buffer_size: int = 5, chunk_size: int = 32768,
                       key: str = "meeting_id", seq: str = "seq", n_bytes: str = "n_bytes",
                       seq_bucket: int = 1 << 20) -> DataFrame:
    """The audio buffer rule. Chunks of a meeting, in ``seq`` order, are
    flushed when the buffer holds ``buffer_size`` chunks or when a chunk is
    shorter than ``chunk_size`` bytes; the buffer then starts empty.

    A short chunk closes a *segment*; inside a segment flush groups are runs
    of ``buffer_size``. Ranks and short-chunk counts come from
    ``segmented_running_count`` (sequence ranges of ``seq_bucket``), so a
    meeting with most of the chunks is still split over many tasks.
    """
    short = F.col(n_bytes) < F.lit(chunk_size)
    ranked = segmented_running_count(
        chunks.withColumn("__short", short), [key], [seq], F.col("__short"),
        F.floor(F.col(seq) / F.lit(seq_bucket)), rank_name="__rank", before_name="segment")
    # The short chunk with k shorts before it ends segment k; segment k+1
    # starts right after it.
    starts = (ranked.filter(F.col("__short"))
              .select(key, (F.col("segment") + 1).alias("segment"), (F.col("__rank") + 1).alias("__start")))
    grouped = (ranked.join(starts, [key, "segment"], "left")
               .withColumn("group_no", F.floor((F.col("__rank") - F.coalesce("__start", F.lit(1)))
                                               / F.lit(buffer_size))))
    out = grouped.groupBy(key, "segment", "group_no").agg(
        F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"),
        F.count(F.lit(1)).alias("n_chunks"), F.sum(n_bytes).cast("long").alias("total_bytes"),
        F.max(F.col("__short").cast("int")).alias("__ends_short"))
    return (out.withColumn("flush_reason",
                           F.when(F.col("n_chunks") == buffer_size, F.lit("full"))
                            .when(F.col("__ends_short") == 1, F.lit("short"))
                            .otherwise(F.lit("open")))
               .drop("__ends_short"))


def _history_stats(history: DataFrame) -> DataFrame:
    """Per-ticket partial sums: history rows are reduced before any join."""
    return history.groupBy("ticket_id").agg(
        F.count("history_id").alias("status_change_count"),
        F.count("changed_at").alias("__n_days"),
        F.sum(F.unix_date(F.to_date("changed_at"))).alias("__sum_days"))


def _with_created(stats: DataFrame, tickets: DataFrame, how: str) -> DataFrame:
    t = tickets.select("ticket_id", "meeting_id", "content", "created_at")
    j = t.join(stats, "ticket_id", how)
    avg_days = F.when(F.col("__n_days") > 0,
                      F.col("__sum_days") / F.col("__n_days") - F.unix_date(F.to_date("created_at")))
    return j.withColumn("avg_days_to_change", avg_days)


def status_changes(history: DataFrame, tickets: DataFrame) -> DataFrame:
    """A4: per ticket, number of changes and mean days from creation to a
    change (``datediff(changed_at, created_at)`` averaged). The mean of the
    differences equals the mean change day minus the creation day, so history
    is reduced per ticket first and only one row per ticket meets the join."""
    j = _with_created(_history_stats(history), tickets, "inner")
    return j.select("ticket_id", "status_change_count", "avg_days_to_change")


def ticket_patterns(history: DataFrame, tickets: DataFrame, blocker_pattern: str, period: str | None = None) -> DataFrame:
    """A5: per meeting, mean of the per-ticket change delay over tickets with
    history, and the number of tickets whose content mentions a blocker. With a
    ``period`` (a ``date_trunc`` unit) there is one row per meeting and period of
    ticket creation, dated by ``analysis_date``, the first day after the period."""
    j = _with_created(_history_stats(history), tickets, "left")
    keys = ["meeting_id"]
    if period is not None:
        after = F.date_trunc(period, "created_at") + F.expr(f"INTERVAL 1 {period}")
        j = j.withColumn("analysis_date", F.to_date(after))
        keys.append("analysis_date")
    return j.groupBy(*keys).agg(
        F.avg("avg_days_to_change").alias("avg_status_change_duration"),
        F.sum(mentions_blocker("content", blocker_pattern)).cast("long").alias("blocker_count"),
        F.count(F.lit(1)).alias("ticket_count"))
