"""Drive the productivity-score stream over the events table (one file per
day, in event-time order, then two closing files) and report micro-batch
duration, state rows and rows dropped by the watermark from the query's own
progress reports.

    python scripts/stream_progress.py [sf_dir]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pyarrow as pa  # noqa: E402
import pyarrow.parquet as pq  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from agendum.operators import metrics as M  # noqa: E402
from agendum.session import build_session, stream_checkpoint  # noqa: E402

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stage(sf_dir: str, out: str) -> None:
    tbl = pq.read_table(f"{sf_dir}/events.parquet")
    tbl = tbl.set_column(tbl.schema.get_field_index("ts"), "ts", tbl.column("ts").cast(pa.timestamp("us", tz="UTC")))
    df = tbl.to_pandas().sort_values("ts")
    mtime = 1_700_000_000
    for i, (_, part) in enumerate(df.groupby(df["ts"].dt.strftime("%Y-%m-%d"), sort=True)):
        path = os.path.join(out, f"{i:04d}.parquet")
        pq.write_table(pa.Table.from_pandas(part, preserve_index=False), path)
        mtime += 10
        os.utime(path, (mtime, mtime))
    first = pa.Table.from_pandas(df.iloc[:1], preserve_index=False)
    for j, day in enumerate(("2030-01-01", "2030-02-01")):
        import pandas as pd
        close = first.set_column(first.schema.get_field_index("ts"), "ts",
                                 pa.array([pd.Timestamp(day, tz="UTC")], pa.timestamp("us", tz="UTC")))
        close = close.set_column(close.schema.get_field_index("user_id"), "user_id", pa.array([-1], pa.int64()))
        path = os.path.join(out, f"9999-{j}.parquet")
        pq.write_table(close, path)
        mtime += 10
        os.utime(path, (mtime, mtime))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    src = tempfile.mkdtemp(prefix="agendum-stream-")
    stage(sf_dir, src)
    spark = build_session("local[8]", app="agendum-stream", shuffle_partitions=8)
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    segs = s.select(F.col("user_id").alias("meeting_id"), "ts")
    tick = s.select(F.col("event_id").cast("string").alias("ticket_id"), F.col("user_id").alias("meeting_id"), "ts",
                    F.when(F.col("event_type") == "view", "TODO").otherwise("DONE").alias("status"))
    out = M.productivity_score(segs, tick, "1 hour")
    name = "progress_" + os.path.basename(src).replace("-", "_")
    q = (out.writeStream.outputMode("append").format("noop").queryName(name)
         .option("checkpointLocation", stream_checkpoint(spark, name)).trigger(availableNow=True).start())
    q.awaitTermination()
    prog = [p for p in q.recentProgress if p.get("numInputRows", 0) > 0]
    dur = [p["durationMs"]["triggerExecution"] for p in prog]
    state = [sum(op.get("numRowsTotal", 0) for op in p.get("stateOperators", [])) for p in prog]
    dropped = sum(op.get("numRowsDroppedByWatermark", 0) for p in prog for op in p.get("stateOperators", []))
    print(json.dumps({"sf_dir": sf_dir, "batches": len(prog), "rows_per_batch": round(statistics.mean(
        p["numInputRows"] for p in prog)), "batch_ms_median": statistics.median(dur), "batch_ms_max": max(dur),
        "state_rows_max": max(state), "rows_dropped_by_watermark": dropped}))
    spark.stop()


if __name__ == "__main__":
    main()
