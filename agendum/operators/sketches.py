"""Mergeable partial results: stored once, merged in any grouping, finished on read.

A partial state is an ordinary row (sums, counts, a sketch as BINARY), so it can
be kept per micro-batch or per day and rolled up later without the raw rows:

* A6 hour-of-day pattern: exact sum and count, and a distinct-count sketch;
* A14 distinct counts: HyperLogLog sketches per (day, group), rolled up to weeks,
  months and the total;
* A16 percentiles: KLL quantile sketches per window, usable on a stream;
* L5 most frequent terms per window: frequent-items sketches beside an exact rank.

Every aggregate combines map-side: a hot key costs one partial row per task. NULL
values enter no sketch; a group with NULLs only has an empty one (count 0, NULL
percentiles).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LG_K = 14             # HLL registers: relative standard error about 1.04 / sqrt(2 ** LG_K), below 1 %
KLL_K = 4096          # KLL: rank error below 0.1 % with 99 % confidence
TOP_K_ITEMS = 4096    # counters of a frequent-items sketch; exact while a group has no more terms

# --- A6 -----------------------------------------------------------------------

SCORE = "decimal(38,6)"   # scores are multiples of 0.1: their sums are exact, whatever the order

# How partial columns of the hour-of-day pattern merge.
HOURLY_MERGE: Mapping[str, str] = {"score_sum": "sum(score_sum)", "meeting_count": "sum(meeting_count)",
                                   "meetings_sketch": "hll_union_agg(meetings_sketch)"}


def hourly_partial(metrics: DataFrame) -> DataFrame:
    """A6, partial: one row per hour of day of the given metric rows."""
    return (metrics.groupBy(F.hour("window_start").alias("hour_of_day"))
            .agg(F.sum(F.col("productivity_score").cast(SCORE)).cast(SCORE).alias("score_sum"),
                 F.count("meeting_id").alias("meeting_count"),
                 F.hll_sketch_agg("meeting_id", F.lit(LG_K)).alias("meetings_sketch")))


def merge_partials(partials: DataFrame, keys: Sequence[str], merges: Mapping[str, str]) -> DataFrame:
    """Merge partial rows of equal ``keys``; ``merges``: SQL aggregate per column."""
    types = dict(partials.dtypes)
    return partials.groupBy(*keys).agg(*[F.expr(sql).cast(types[c]).alias(c) for c, sql in merges.items()])


def finish_hourly(partials: DataFrame) -> DataFrame:
    """A6 from merged partial rows: hour_of_day, avg_score, meeting_count, distinct_meetings."""
    n = F.col("meeting_count")
    return partials.select("hour_of_day", F.try_divide(F.col("score_sum").cast("double"), n.cast("double")).alias("avg_score"), n,
                           F.hll_sketch_estimate("meetings_sketch").alias("distinct_meetings"))


# --- A14 ----------------------------------------------------------------------

def distinct_sketches(rows: DataFrame, value: str, keys: Sequence[str] = (), ts: str = "ts", lg_k: int = LG_K) -> DataFrame:
    """One sketch of the distinct ``value`` per calendar day and ``keys``."""
    return (rows.groupBy(F.to_date(ts).alias("day"), *keys)
            .agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"), F.count(value).alias("n_rows")))


# Start of the period a day belongs to; the total has none.
PERIODS = {"day": lambda d: d, "week": lambda d: F.trunc(d, "week"), "month": lambda d: F.trunc(d, "month"),
           "total": lambda d: F.lit(None).cast("date")}


def roll_up_distinct(sketches: DataFrame, period: str, keys: Sequence[str] = ()) -> DataFrame:
    """Daily sketches -> distinct values per period (``PERIODS``) and ``keys``
    (fewer keys than stored ones merge groups, too): period, period_start, keys,
    n_rows, distinct_values. Only sketches are read, one per day and stored key."""
    start = PERIODS[period](F.col("day")).alias("period_start")
    return (sketches.groupBy(start, *keys)
            .agg(F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))
            .select(F.lit(period).alias("period"), "period_start", *keys, "n_rows", "distinct_values"))


# --- A16 ----------------------------------------------------------------------

def quantile_sketches(latency: DataFrame, metrics: Sequence[str], window: Column | None = None, keys: Sequence[str] = (), k: int = KLL_K) -> DataFrame:
    """A16 at scale: per ``window`` (any grouping column; none: all rows), ``keys``
    and metric one KLL sketch with count, sum and maximum. Works on streams."""
    long = latency.withColumn("__m", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))).withColumn("v", F.col("__m.v"))
    group = ([] if window is None else [window.alias("window")]) + [F.col(c) for c in keys] + [F.col("__m.metric").alias("metric")]
    return (long.filter(F.col("v").isNotNull()).groupBy(*group)
            .agg(F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"), F.count("v").alias("n"), F.sum("v").alias("v_sum"), F.max("v").alias("v_max")))


QUANTILE_MERGE: Mapping[str, str] = {"sketch": "kll_merge_agg_double(sketch)", "n": "sum(n)", "v_sum": "sum(v_sum)", "v_max": "max(v_max)"}


def finish_quantiles(sketches: DataFrame, keys: Sequence[str] = ("metric",), probs: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Merge the sketches of equal ``keys`` and read count, mean, the values at the
    ranks ``probs`` (inclusive; a value of the data, not interpolated) and maximum."""
    merged = merge_partials(sketches, keys, QUANTILE_MERGE)
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"p{int(round(p * 100))}") for p in probs]
    return merged.select(*keys, "n", (F.col("v_sum") / F.col("n")).alias("avg"), *at, F.col("v_max").alias("max"))


# --- L5 -----------------------------------------------------------------------

def top_terms_per_window(terms: DataFrame, window: Column, k: int, term: str = "term", keys: Sequence[str] = ()) -> DataFrame:
    """L5 per window, exact: the k most frequent terms of each window and ``keys``
    (ties by term): window, keys, term, n, rank. Counts first, so the rank reads
    one row per distinct term, of which Spark keeps k per task before the shuffle."""
    counts = terms.filter(F.col(term).isNotNull()).groupBy(window.alias("window"), *keys, F.col(term).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy("window", *keys).orderBy(F.col("n").desc(), "term")
    return counts.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def term_sketches(terms: DataFrame, window: Column, term: str = "term", keys: Sequence[str] = (), items: int = TOP_K_ITEMS) -> DataFrame:
    """L5 per window, mergeable: one frequent-items sketch per window and ``keys``."""
    return (terms.filter(F.col(term).isNotNull()).groupBy(window.alias("window"), *keys)
            .agg(F.expr(f"approx_top_k_accumulate({term}, {items})").alias("sketch")))


def top_of_sketches(sketches: DataFrame, keys: Sequence[str], k: int, items: int = TOP_K_ITEMS) -> DataFrame:
    """Merge sketches of equal ``keys`` and read the k most frequent terms: keys,
    term, n (never below the true count), rank (ties by term)."""
    merged = sketches.groupBy(*keys).agg(F.expr(f"approx_top_k_combine(sketch, {items})").alias("sketch"))
    found = merged.select(*keys, F.explode(F.expr(f"approx_top_k_estimate(sketch, {items})")).alias("e"))
    place = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "term")
    return (found.select(*keys, F.col("e.item").alias("term"), F.col("e.count").alias("n"))
            .withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k))
