"""Sinks (S2-S5, S9, S10): event values, topic routing, metric tables.

No sink pulls rows to the driver: values are built with ``to_json`` on the
executors and written by Spark's own writers, per micro-batch where needed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from agendum.operators.relational import upsert
from agendum.operators.sketches import merge_partials
from agendum.session import stream_checkpoint

# --- fixed values -----------------------------------------------------------
# Topics of the metric streams and the message type each carries.
METRIC_TOPICS = {
    "ticket_metrics": "analytics.ticket.metrics",
    "productivity": "analytics.productivity",
    "trends": "analytics.trends.groups",
}
# ---------------------------------------------------------------------------


def to_event_value(df: DataFrame, key: str | None = None) -> DataFrame:
    """One JSON ``value`` per row, NULL fields kept (``ignoreNullFields``
    false), optional ``key`` for partitioning the topic."""
    cols = [F.to_json(F.struct(*[F.col(c) for c in df.columns]),
                      {"ignoreNullFields": "false"}).alias("value")]
    if key:
        cols.insert(0, F.col(key).cast("string").alias("key"))
    return df.select(*cols)


def envelope(df: DataFrame, msg_type: str, topic: str, ts: str | None = None,
             key: str | None = None) -> DataFrame:
    """S3 helper: ``{type, data: {...row...}, timestamp}`` routed to ``topic``."""
    stamp = F.col(ts).cast("string") if ts else F.current_timestamp().cast("string")
    value = F.to_json(F.struct(F.lit(msg_type).alias("type"),
                               F.struct(*[F.col(c) for c in df.columns]).alias("data"),
                               stamp.alias("timestamp")), {"ignoreNullFields": "false"})
    cols = [F.lit(topic).alias("topic"), value.alias("value")]
    if key:
        cols.insert(1, F.col(key).cast("string").alias("key"))
    return df.select(*cols)


def route_metrics(frames: Mapping[str, DataFrame], topics: Mapping[str, str] = METRIC_TOPICS,
                  ts: str | None = "window_start", key: str | None = None) -> DataFrame:
    """S3: all metric kinds in one frame of (topic, value); a Kafka sink
    honours the per-row ``topic`` column, so one query feeds every topic."""
    out = None
    for kind, df in frames.items():
        e = envelope(df, kind, topics[kind], ts if ts in df.columns else None,
                     key if key and key in df.columns else None)
        if key and key not in df.columns:
            e = e.withColumn("key", F.lit(None).cast("string")).select("topic", "key", "value")
        out = e if out is None else out.unionByName(e)
    return out


def write_events(df: DataFrame, topic: str | None, checkpoint: str, mode: str = "append",
                 fmt: str = "kafka", options: Mapping[str, str] | None = None,
                 path: str | None = None, trigger: Mapping | None = None) -> StreamingQuery:
    """Stream rows to a topic as JSON values with a checkpoint. Kafka is
    the production format; ``fmt='parquet'|'json'`` with ``path`` writes the
    same (key, value, topic) columns to files (tests, replay)."""
    cols = df.columns
    out = df if "value" in cols else to_event_value(df)
    if topic and "topic" not in out.columns:
        out = out.withColumn("topic", F.lit(topic))
    w = out.writeStream.outputMode(mode).format(fmt).option("checkpointLocation", checkpoint)
    for k, v in (options or {}).items():
        w = w.option(k, v)
    if trigger:
        w = w.trigger(**trigger)
    return w.start(path) if path else w.start()


def debug_sink(df: DataFrame, name: str, fmt: str = "memory", mode: str = "append") -> StreamingQuery:
    """Console or in-memory table for inspection."""
    return df.writeStream.outputMode(mode).format(fmt).queryName(name).start()


def _batch_path(target: str, kind: str, batch_id: int) -> str:
    return f"{target}/{kind}/batch_id={batch_id}"


def write_metric_batch(df: DataFrame, kind: str, target: str, batch_id: int) -> None:
    """S5 (append kinds): each micro-batch overwrites its own ``batch_id``
    folder, so a replayed batch after a failure rewrites, never duplicates."""
    df.write.mode("overwrite").parquet(_batch_path(target, kind, batch_id))


KEEP_VERSIONS = 3     # newest versions that stay, for readers at work and replays


def _newest(spark: SparkSession, base_dir: str, below: int | None = None) -> tuple[DataFrame | None, list[int]]:
    """(newest version's rows without ``v``, all version numbers) of a versioned table."""
    try:
        versions = spark.read.parquet(base_dir)
    except AnalysisException:
        return None, []
    numbers = sorted(r["v"] for r in versions.select("v").distinct().collect())     # at most KEEP_VERSIONS + 1
    earlier = [v for v in numbers if below is None or v < below]
    # The filter is a literal: only that version's folder is read, never the one being written.
    return (versions.filter(F.col("v") == F.lit(earlier[-1])).drop("v") if earlier else None), numbers


def _write_version(spark: SparkSession, target: str, version: int, merge: Callable[[DataFrame | None], DataFrame]) -> str:
    """Write ``merge(newest earlier version)`` as ``version``. Rewriting a version is
    idempotent; versions older than the newest ``KEEP_VERSIONS`` are removed."""
    base_dir = f"{target}/versions"
    path = f"{base_dir}/v={version}"
    before, numbers = _newest(spark, base_dir, version)
    merge(before).write.mode("overwrite").parquet(path)
    for old in sorted({*numbers, version})[:-KEEP_VERSIONS]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base_dir}/v={old}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return path


def upsert_metric_table(spark: SparkSession, df: DataFrame, target: str, keys: Sequence[str],
                        update_cols: Sequence[str], version: int) -> str:
    """S5 (upsert kind): replace the batch's keys in the newest earlier version of
    the table and write the result as version ``version`` (a ``v=`` partition
    folder); readers take the highest version (``read_versioned``). Versions are
    found by Spark's own partition discovery, on any file system the cluster uses."""
    return _write_version(spark, target, version,
                          lambda prev: df if prev is None else upsert(prev, df.select(*prev.columns), keys, update_cols))


def merge_metric_table(spark: SparkSession, partials: DataFrame, target: str, keys: Sequence[str],
                       merges: Mapping[str, str], version: int) -> str:
    """S5 (mergeable kind): add the batch's partial rows to those stored, column by
    column (``merges``: SQL aggregate per column). The result is the same however
    the rows were cut into batches, and a replayed batch starts from the version
    before it, so it counts once."""
    return _write_version(spark, target, version, lambda prev: merge_partials(
        partials if prev is None else prev.unionByName(partials.select(*prev.columns)), keys, merges))


def read_versioned(spark: SparkSession, target: str) -> DataFrame:
    """The newest version of an upserted or merged table."""
    rows, _ = _newest(spark, f"{target}/versions")
    if rows is None:
        raise FileNotFoundError(f"{target}/versions")
    return rows


def metrics_foreach_batch(writers: Mapping[str, Callable[[DataFrame], DataFrame]], target: str):
    """A ``foreachBatch`` function that persists the micro-batch once
    and writes every metric kind from it, then releases it."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for kind, build in writers.items():
                write_metric_batch(build(batch), kind, target, batch_id)
        finally:
            batch.unpersist()
    return run


def start_metric_sink(df: DataFrame, writers: Mapping[str, Callable[[DataFrame], DataFrame]],
                      target: str, name: str, mode: str = "append",
                      trigger: Mapping | None = None) -> StreamingQuery:
    spark = df.sparkSession
    w = (df.writeStream.outputMode(mode).queryName(name)
         .option("checkpointLocation", stream_checkpoint(spark, name))
         .foreachBatch(metrics_foreach_batch(writers, target)))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append",
               options: Mapping[str, str] | None = None) -> None:
    """S5 to a relational table: Spark's JDBC writer, one connection per
    partition (``numPartitions`` caps concurrent connections)."""
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).mode(mode)
    for k, v in (options or {}).items():
        w = w.option(k, v)
    w.save()
