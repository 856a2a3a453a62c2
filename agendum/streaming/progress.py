"""Z3: what a stream read, kept and dropped, as a table.

Spark drops rows older than the watermark without a trace in the results. The
listener writes one row per micro-batch: rows read, rows each query's stateful
operators dropped as late, state rows and the watermark. (The dropped count is of
rows that reach an operator: after a partial aggregate one row may stand for
several late source rows of one window and key.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = ("query string, query_id string, batch_id long, batch_time string, watermark string, input_rows long, "
          "late_rows long, state_rows long, state_bytes long")


class ProgressTable(StreamingQueryListener):
    """Writes every progress event to ``path``: one folder per query and batch, so a
    replayed batch rewrites its row. Register with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        total = lambda name: sum(int(getattr(op, name)) for op in p.stateOperators)
        row = (p.name, str(p.id), p.batchId, p.timestamp, p.eventTime.get("watermark"), p.numInputRows,
               total("numRowsDroppedByWatermark"), total("numRowsTotal"), total("memoryUsedBytes"))
        target = f"{self.path}/source={p.name or p.id}/batch={p.batchId}"
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("overwrite").parquet(target)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA + ", source string, batch long").option("basePath", path).parquet(path).drop("source", "batch")
