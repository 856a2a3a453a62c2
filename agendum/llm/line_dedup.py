"""Line dedup over levelled sorted runs of line hashes.

The rows' line keys (two 64-bit hashes of the trimmed, A-Z lower-cased line)
are written once, then taken in batches. Runs hold (key, number of documents),
hashed into buckets and sorted by key, so joins and merges of runs need no
shuffle. Each batch is merge-anti-joined with the settled keys of the runs (those
already found in ``min_docs`` documents: nothing can change about them), and what
remains is added as a run of level 0. ``FANOUT`` runs of a level are compacted
into one of the next level. At the end the runs' counts are summed; keys found
in at least ``min_docs`` documents lose all their lines everywhere.

A document is a distinct (doc_id, text): a repeated row is the same document. A
line is counted once a document. All of a document is in one batch, so counts of
batches add up.

Edge cases: a null or empty text is one empty line, which is never dropped, nor
is any line of white space only; repeated rows lose the same lines; an empty
table gives no rows; other columns are kept by ``without_common_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agendum.llm.storage import cut, new_path, release

MIN_DOCS = 10
BATCHES = 4
FANOUT = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\f\r"


def line_key(line: F.Column) -> F.Column:
    """Trimmed and A-Z lower-cased; ``lower`` does just that on ASCII lines."""
    line = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def lines_of(text: F.Column) -> F.Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def doc_key(docs: DataFrame) -> list[F.Column]:
    """Two columns by which equal (doc_id, text) are equal, nulls included."""
    return [F.xxhash64("doc_id", "text").alias("d1"), F.xxhash64(F.lit(1), F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id")).alias("d2")]


class Runs:
    """Levelled runs of (h1, h2, n), each a table bucketed and sorted by key."""

    def __init__(self, spark, buckets: int, min_docs: int):
        self.spark, self.buckets, self.min_docs = spark, buckets, min_docs
        self.levels: list[list[DataFrame]] = []

    def _write(self, counts: DataFrame) -> DataFrame:
        path = new_path(self.spark, "line-run")
        name = "line_run_" + path.rsplit("-", 1)[1]
        (counts.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", path).saveAsTable(name))
        return self.spark.table(name)

    @staticmethod
    def merge(runs: list[DataFrame]) -> DataFrame:
        """One run with the counts of all: keys are unique in a run, so sorted
        runs merge by outer joins, bucket by bucket."""
        out = runs[0]
        for run in runs[1:]:
            both = out.withColumnRenamed("n", "n1").join(run.withColumnRenamed("n", "n2"), ["h1", "h2"], "full")
            out = both.select("h1", "h2", (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"))
        return out

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Add the batch's (document, key) rows, but for the keys that a run
        alone shows in ``min_docs`` documents."""
        counts = batch.groupBy("h1", "h2").agg(F.count("*").alias("n"))
        for run in self.runs():
            counts = counts.join(run.where(F.col("n") >= self.min_docs).select("h1", "h2"), ["h1", "h2"], "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(counts))
        level = 0
        while len(self.levels[level]) >= FANOUT:
            merged = self._write(self.merge(self.levels[level]))
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(merged)
        release(self.spark)

    def common(self) -> DataFrame:
        return self.merge(self.runs()).where(F.col("n") >= self.min_docs).select("h1", "h2")


def marked_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """d1, d2 (document), dropped (array of line numbers from 0) of the documents that lose lines."""
    spark = docs.sparkSession
    key = F.col("key")
    lines = (docs.select(*doc_key(docs), F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
             .withColumn("key", line_key(F.col("line"))).where(F.length("key") >= 1)
             .select("d1", "d2", "line_no", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"),
                     F.pmod("d1", F.lit(batches)).alias("batch")))
    path = new_path(spark, "line-keys")
    lines.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = Runs(spark, buckets, min_docs)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).select("d1", "d2", "h1", "h2").distinct())
    common = cut(runs.common(), "line-common")
    return (lines.join(common, ["h1", "h2"]).groupBy("d1", "d2").agg(F.collect_set("line_no").alias("dropped")))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with columns _n_lines, _n_dropped, _kept (the text without the common lines)."""
    marks = cut(marked_lines(docs, min_docs, batches), "line-marks")
    d1, d2 = doc_key(docs)
    keyed = docs.withColumns({"_d1": d1, "_d2": d2})
    joined = keyed.join(marks.select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("dropped").alias("_dropped")), ["_d1", "_d2"], "left")
    lines = lines_of(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_dropped"))
    kept = F.when(F.col("_dropped").isNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return joined.select(*docs.columns, F.size(lines).cast("long").alias("_n_lines"),
                         F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")).cast("long").alias("_n_dropped"), kept.alias("_kept"))


def without_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the common lines gone from ``text`` and ``n_chars`` recounted."""
    out = dedup_lines(docs, min_docs)
    changed = F.col("_n_dropped") > 0
    cols = {"text": F.when(changed, F.col("_kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(changed, F.length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(cols).select(*docs.columns)
