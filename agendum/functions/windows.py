"""Ordered per-key work that stays parallel when one key is hot.

A plain ``lag().over(partitionBy(key))`` sends every row of a key to one
task. Here the key's rows are cut into segments (for example a day of event
time or a range of sequence numbers); the offset or running value is computed
inside each segment in parallel, and the one value that crosses a segment
border is carried over from a per-segment summary that has one row per
segment.

The summary is read off the same windowed rows (the border row of each
segment), so the large input is shuffled and sorted once; the plan reuses
that exchange for the summary branch. Only the small summary is shuffled
by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segmented_shift(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                    value_cols: Sequence[str], segment: Column, direction: str = "lag",
                    prefix: str | None = None) -> DataFrame:
    """Add ``{prefix}{c}`` = value of ``c`` on the previous (lag) or next (lead)
    row of the same key, ordered by ``order_cols`` (a total order per key).

    Equal to ``lag(c).over(partitionBy(keys).orderBy(order_cols))`` provided
    ``segment`` is monotone in the order (a coarser version of it).
    """
    if direction not in ("lag", "lead"):
        raise ValueError(direction)
    prefix = prefix or ("prev_" if direction == "lag" else "next_")
    seg = "__seg"
    within = Window.partitionBy(*keys, seg).orderBy(*order_cols)
    shift, other = (F.lag, F.lead) if direction == "lag" else (F.lead, F.lag)
    out = (df.withColumn(seg, segment)
             .withColumn("__edge", shift(F.lit(1)).over(within).isNull())      # first (lag) / last (lead) row
             .withColumn("__border", other(F.lit(1)).over(within).isNull()))   # row whose value crosses over
    for c in value_cols:
        out = out.withColumn(prefix + c, shift(F.col(c)).over(within))

    across = Window.partitionBy(*keys).orderBy(seg)
    summary = (out.filter(F.col("__border"))
                  .select(*keys, seg, F.struct(*[F.col(c) for c in value_cols]).alias("__v"))
                  .withColumn("__carry", shift(F.col("__v")).over(across))
                  .select(*keys, seg, "__carry"))
    out = out.join(summary, on=[*keys, seg], how="left")
    for c in value_cols:
        out = out.withColumn(
            prefix + c,
            F.when(F.col("__edge"), F.col("__carry")[c]).otherwise(F.col(prefix + c)))
    return out.drop(seg, "__edge", "__border", "__carry")


def segmented_running_count(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                            flag: Column, segment: Column,
                            rank_name: str = "rank", before_name: str = "flags_before") -> DataFrame:
    """Add a 1-based ``rank`` per key and ``flags_before`` = number of earlier
    rows of the key where ``flag`` is true, without one task per key.
    """
    seg = "__seg"
    within = Window.partitionBy(*keys, seg).orderBy(*order_cols)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    local = (df.withColumn(seg, segment).withColumn("__flag", flag.cast("long"))
               .withColumn("__rn", F.row_number().over(within))
               .withColumn("__fi", F.sum("__flag").over(upto))                 # flags up to this row
               .withColumn("__last", F.lead(F.lit(1)).over(within).isNull()))
    before = Window.partitionBy(*keys).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    totals = (local.filter(F.col("__last"))
                   .select(*keys, seg, F.col("__rn").alias("__n"), F.col("__fi").alias("__f"))
                   .withColumn("__n0", F.coalesce(F.sum("__n").over(before), F.lit(0)))
                   .withColumn("__f0", F.coalesce(F.sum("__f").over(before), F.lit(0)))
                   .select(*keys, seg, "__n0", "__f0"))
    out = local.join(totals, on=[*keys, seg], how="inner")
    return (out.withColumn(rank_name, F.col("__n0") + F.col("__rn"))
               .withColumn(before_name, F.col("__f0") + F.col("__fi") - F.col("__flag"))
               .drop(seg, "__flag", "__rn", "__fi", "__last", "__n0", "__f0"))


def segmented_runs(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                   carry_cols: Sequence[str], starts, segment: Column, run_name: str = "run") -> DataFrame:
    """Number runs per key in one segmented pass: a row opens a new run when
    it is the key's first row or ``starts(prev, cur)`` is true, where
    ``prev``/``cur`` map each of ``carry_cols`` to the previous/current row's
    column. Runs are numbered 1, 2, ... per key in order.

    Inside a segment the boundary flags and their running sum come from one
    window; the first row of each segment is decided from the previous
    segment's last row, carried by a one-row-per-segment summary."""
    seg = "__seg"
    within = Window.partitionBy(*keys, seg).orderBy(*order_cols)
    local = (df.withColumn(seg, segment)
               .withColumn("__first", F.lag(F.lit(1)).over(within).isNull())
               .withColumn("__last", F.lead(F.lit(1)).over(within).isNull()))
    prev = {c: F.lag(F.col(c)).over(within) for c in carry_cols}
    cur = {c: F.col(c) for c in carry_cols}
    local = (local.withColumn("__s", F.when(F.col("__first"), F.lit(0))
                              .otherwise(F.coalesce(starts(prev, cur), F.lit(False)).cast("int")))
                  .withColumn("__cum", F.sum("__s").over(within.rowsBetween(Window.unboundedPreceding, 0))))
    vals = F.struct(*[F.col(c) for c in carry_cols])
    summ = (local.filter(F.col("__first") | F.col("__last"))
                 .select(*keys, seg, F.when(F.col("__first"), vals).alias("__fv"),
                         F.when(F.col("__last"), vals).alias("__lv"),
                         F.when(F.col("__last"), F.col("__cum")).alias("__tot"))
                 .groupBy(*keys, seg)
                 .agg(F.max("__fv").alias("__fv"), F.max("__lv").alias("__lv"), F.max("__tot").alias("__tot")))
    across = Window.partitionBy(*keys).orderBy(seg)
    carry = F.lag("__lv").over(across)
    summ = (summ.withColumn("__carry", carry)
                .withColumn("__edge", F.when(F.col("__carry").isNull(), F.lit(1)).otherwise(F.coalesce(
                    starts({c: F.col("__carry")[c] for c in carry_cols},
                           {c: F.col("__fv")[c] for c in carry_cols}), F.lit(False)).cast("int")))
                .withColumn("__segtot", F.col("__tot") + F.col("__edge")))
    summ = summ.withColumn("__before", F.coalesce(
        F.sum("__segtot").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = local.join(summ.select(*keys, seg, "__edge", "__before"), on=[*keys, seg], how="inner")
    return (out.withColumn(run_name, (F.col("__before") + F.col("__edge") + F.col("__cum")).cast("long"))
               .drop(seg, "__first", "__last", "__s", "__cum", "__edge", "__before"))
