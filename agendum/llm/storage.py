"""Lineage cuts in the shared folder, and code shipping to Python workers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without the setting (tests) gets a scratch folder."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_CONF} is not set; point it at a shared folder")
        path = tempfile.mkdtemp(prefix="agendum-shared-")
        spark.conf.set(CHECKPOINT_CONF, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/agendum/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later work starts
    from those files, whatever executors are lost."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Cuts:
    """Tables of one run that later steps replace. The shuffle files of a written
    table go at once, and ``drop`` removes tables that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        before = self.spark.conf.get(SHUFFLE_CLEANUP_CONF)
        self.spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP_CONF, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that ``cut`` returned; only what is read from other cuts may come after."""
        for df in tables:
            if df is None:
                continue
            _, path = self.paths.pop(id(df))
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def release(self) -> None:
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Let go of the broadcasts of finished joins, on the driver and on the executors:
    Spark removes them when the driver collects its garbage, which a driver with
    a free heap puts off."""
    gc.collect()
    spark._jvm.System.gc()


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` of a task. At its end the Python worker gives the memory of freed
    arrays back to the system: Spark keeps the worker for later tasks, and while
    it idles, other stages need that memory."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)    # of glibc
    if trim:
        trim(0)


def broadcast_if_small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Mark ``df`` (``rows`` counted rows of a few fixed-width columns) for
    broadcast when it is proven small; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if rows <= max_rows else df


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers of any cluster, once per
    application."""
    sc = spark.sparkContext
    if getattr(sc, "_agendum_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = os.path.join(tempfile.mkdtemp(prefix="agendum-code-"), "agendum_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "agendum").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(target)
    sc._agendum_shipped = True
