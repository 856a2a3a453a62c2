"""Keyword and topic models on Spark ML (M1-M4).

Fitting happens on batch data (or inside ``foreachBatch`` on a stream);
fitted models transform streams directly. Word2Vec (M2) is trained by
``word_vectors`` with its vocabulary in a table; only a stream that it scores
takes the vocabulary through the driver, so there ``min_count`` bounds it.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, Word2VecModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agendum.functions.expressions import WHITESPACE_PATTERN, tokens
from agendum.operators import word_vectors as W
from agendum.session import CHECKPOINT_CONF, checkpoint_dir

SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

cloudpickle.register_pickle_by_value(W)    # workers need not have this package


def fit_keywords(df: DataFrame, text: str = "text", num_features: int = 1 << 18) -> PipelineModel:
    """M1: tokenizer → hashed term frequencies → IDF, output ``tfidf_vec``."""
    stages = [RegexTokenizer(inputCol=text, outputCol="__words", pattern=WHITESPACE_PATTERN, gaps=True,
                             toLowercase=True, minTokenLength=1),
              HashingTF(inputCol="__words", outputCol="__tf", numFeatures=num_features),
              IDF(inputCol="__tf", outputCol="tfidf_vec")]
    return Pipeline(stages=stages).fit(df)


def keyword_features(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("__words", "__tf")


class TopicVectors:
    """Fitted word vectors (M2) as a table ``vectors`` (word, vec); ``topic_vec`` of a
    text is the mean over its tokens, a token without a vector counting as zeros."""

    def __init__(self, vectors: DataFrame, size: int):
        self.vectors, self.size = vectors, size

    def getVectors(self) -> DataFrame:
        return self.vectors.select("word", array_to_vector("vec").alias("vector"))

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Adds ``topic_vec``. Rows are dealt over as many parts as the session runs
        tasks at once, and a part's task holds the vectors of its own words."""
        if df.isStreaming:
            return self._transform_stream(df, text)
        n = df.sparkSession.sparkContext.defaultParallelism
        rows = _cut(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _dealt(n).alias("part")), "topic-rows")
        texts = rows.select("part", F.lit(True).alias("is_text"), F.lit(None).cast("string").alias("word"),
                            F.lit(None).cast("array<float>").alias("vec"), "row")
        words = (rows.select("part", F.explode(tokens(f"row.`{text}`")).alias("word")).distinct()
                 .join(self.vectors, "word")
                 .select("part", F.lit(False).alias("is_text"), "word", "vec", F.lit(None).cast(rows.schema["row"].dataType).alias("row")))
        scored = (words.union(texts).repartitionById(n, F.col("part")).sortWithinPartitions("part", "is_text")
                  .select("part", "is_text", "word", "vec", tokens(f"row.`{text}`").alias("tokens"), "row")
                  .mapInArrow(W.score(self.size), T.StructType([rows.schema["row"], T.StructField("vec", T.ArrayType(T.DoubleType()))])))
        return scored.select("row.*", array_to_vector("vec").alias("topic_vec"))

    def _transform_stream(self, df: DataFrame, text: str) -> DataFrame:
        """A stream has no second look at its rows: every worker gets all vectors, through the driver."""
        table = self.vectors.toArrow().combine_chunks()
        words, vec = table["word"].combine_chunks().cast("string"), W.rows_of(table["vec"].combine_chunks(), self.size)
        sent = df.sparkSession.sparkContext.broadcast((words, vec))

        @F.arrow_udf("array<double>")
        def mean(texts: pa.Array) -> pa.Array:
            words, vec = sent.value
            return W.listed(W.mean_vectors(*W.found(texts, words), vec))

        return df.withColumn("topic_vec", array_to_vector(mean(tokens(text))))


def _cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the session's shared folder and read from there: later work
    sees the same rows however often it reads them. Its shuffle files go at once."""
    spark = df.sparkSession
    shared = spark.conf.get(CHECKPOINT_CONF, None) or checkpoint_dir(spark)
    path = f"{shared.rstrip('/')}/agendum/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP_CONF)
    spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def _drop(*tables: DataFrame) -> None:
    """Delete the tables of ``_cut`` that these read, once nothing else does."""
    for df in tables:
        for folder in {os.path.dirname(f) for f in df.inputFiles() if "/agendum/topic-" in f}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def _dealt(n: int) -> Column:
    """Rows of each input partition in turn to ``n`` parts, whatever they hold."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")


def fit_topic_vectors(df: DataFrame, text: str = "text", size: int = 100, min_count: int = 5,
                      seed: int = 42, max_iter: int = 1, num_partitions: int | None = None) -> TopicVectors:
    """M2: Word2Vec (skip-gram, hierarchical softmax) over the token lists, trained
    in ``num_partitions`` tasks (the session's parallelism by default) whose
    vectors are averaged after each iteration, as Spark ML does it. The driver
    sees how many words have a count, never the words; a task gets the vectors
    of its own words and of the tree's nodes above them."""
    parts = num_partitions or df.sparkSession.sparkContext.defaultParallelism
    texts = _cut(df.select(_dealt(parts).alias("part"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL"), "topic-texts")
    local = _cut(texts.select("part", F.explode(tokens("text")).alias("word")).groupBy("part", "word").agg(F.count("*").alias("n")), "topic-counts")
    counted = local.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    words = _cut(counted.repartitionByRange(F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word")
                 .withColumn("at", F.monotonically_increasing_id()), "topic-words")
    task = F.shiftright("at", 33)
    sizes = sorted(words.groupBy(task.alias("task"), "n").agg(F.count("*").alias("words")).collect(), key=lambda r: (r.task, -r.n))
    if not sizes:
        raise ValueError(f"no word occurs {min_count} times")
    classes, starts, total = {}, {}, 0
    for r in sizes:
        starts.setdefault(r.task, sum(classes.values()) if r.task not in starts else 0)
        classes[r.n] = classes.get(r.n, 0) + r.words
        total += r.n * r.words
    tree = W.huffman([*classes.items()])
    start = F.broadcast(df.sparkSession.createDataFrame([*starts.items()], "task long, start long"))   # a row for each task
    ids = words.join(start, task == F.col("task")).select("word", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("id"))
    rows = local.select("part", "word").join(ids, "word").select("part", "id", "word", F.lit(None).cast("array<float>").alias("vec"))
    read = texts.select("part", F.lit(True).alias("is_text"), F.xxhash64("text").alias("id"), F.col("text").alias("word"),
                        F.lit(None).cast("array<float>").alias("vec"))
    def mean(trained: DataFrame) -> DataFrame:
        return (trained.repartition("id").sortWithinPartitions("id").select("id", "word", "vec")
                .mapInArrow(W.mean_of_parts(size, seed), "id long, word string, vec array<float>"))

    trained, steps = rows, []
    for step in range(max_iter):
        if step:
            rows = trained.select("part", "id", "word").join(mean(trained).select("id", "vec"), "id").select("part", "id", "word", "vec")
        trained = (rows.select("part", F.lit(False).alias("is_text"), "id", "word", "vec").union(read)
                   .repartitionById(parts, F.col("part")).sortWithinPartitions("part", "is_text", "id")
                   .select("part", "is_text", "id", F.when(~F.col("is_text"), F.col("word")).alias("word"), "vec",
                           F.when(F.col("is_text"), tokens("word")).alias("tokens"))
                   .mapInArrow(W.train(tree, size, seed, step, max_iter, parts, total), "part int, id long, word string, vec array<float>"))
        if step + 1 < max_iter:
            steps.append(trained := _cut(trained, "topic-step"))
    vectors = _cut(mean(trained).select("word", "vec"), "topic-vectors")
    _drop(texts, local, words, *steps)
    return TopicVectors(vectors, size)


def score_stream(df: DataFrame, model, text: str = "text") -> DataFrame:
    """M3: apply a fitted model to a stream (or batch) frame."""
    if isinstance(model, TopicVectors):
        return model.transform(df, text)
    if isinstance(model, Word2VecModel):
        return model.transform(df.withColumn("__tokens", tokens(text))).drop("__tokens")
    return model.transform(df)


def cluster_topics(df: DataFrame, k: int = 8, text: str = "text", size: int = 100, min_count: int = 5,
                   seed: int = 42) -> DataFrame:
    """M4: segment vectors (mean word vector) clustered with k-means;
    adds ``topic``."""
    w2v = fit_topic_vectors(df, text, size, min_count, seed)
    vec = _cut(scored := score_stream(df, w2v, text), "topic-segments")
    _drop(scored)
    km = KMeans(k=k, seed=seed, featuresCol="topic_vec", predictionCol="topic").fit(vec)
    return km.transform(vec).drop("topic_vec").withColumn("topic", F.col("topic").cast("int"))
