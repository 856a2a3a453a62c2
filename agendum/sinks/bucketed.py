"""U1 against a large base: a versioned table that Spark buckets by its key.

A version is a bucketed, sorted Parquet table. An upsert joins the newest version
bucket by bucket, so only the changes are shuffled, however large the base is, and
the merged rows are written into their buckets without another shuffle. Versions
are numbered by the caller (a micro-batch id, say): writing one again starts from
the version before it, so a replay gives the same table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from agendum.operators.relational import upsert

KEEP_VERSIONS = 3


class BucketedTable:
    """Versions ``name_v<n>`` under the folder ``target`` that all executors share.

    ``buckets`` below ``spark.sql.shuffle.partitions`` would make Spark shuffle the
    base after all, so that number is the least."""

    def __init__(self, spark: SparkSession, name: str, target: str, keys: Sequence[str], buckets: int):
        self.spark, self.name, self.target, self.keys = spark, name, target, list(keys)
        self.buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def table(self, version: int) -> str:
        return f"{self.name}_v{version}"

    def read(self, version: int) -> DataFrame:
        return self.spark.table(self.table(version))

    def _write(self, df: DataFrame, version: int) -> DataFrame:
        (df.write.mode("overwrite").format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
         .option("path", f"{self.target}/v={version}").saveAsTable(self.table(version)))
        return self.read(version)

    def create(self, df: DataFrame, version: int = 0) -> DataFrame:
        """The first version: the one time that the base is shuffled."""
        return self._write(df.repartition(self.buckets, *self.keys), version)

    def register(self, like: DataFrame, version: int) -> DataFrame:
        """Name a version that an earlier session wrote (its catalog may be gone)."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
        keys = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table(version)} ({columns}) USING parquet "
                       f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.target}/v={version}'")
        return self.read(version)

    def merged(self, changes: DataFrame, update_cols: Sequence[str], version: int) -> DataFrame:
        """The rows of ``version``: the version before it with ``changes`` (one row a key) applied."""
        return upsert(self.read(version - 1), changes, self.keys, update_cols)

    def upsert(self, changes: DataFrame, update_cols: Sequence[str], version: int) -> DataFrame:
        """Write ``merged`` as ``version``; versions older than the newest ``KEEP_VERSIONS`` go."""
        out = self._write(self.merged(changes, update_cols, version), version)
        old = version - KEEP_VERSIONS
        if old >= 0 and self.spark.catalog.tableExists(self.table(old)):
            self.spark.sql(f"DROP TABLE {self.table(old)}")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.target}/v={old}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return out
