"""From raw documents to packed training sequences, stage by stage.

Each stage calls one operator of ``agendum.llm`` on all that the stage before it
kept: toxic documents go, common lines go, one document of each near-duplicate
group stays, documents with benchmark items go, the rest is packed. A stage
takes (spark, docs, sf_dir); its result is written as Parquet and read again as
the next stage's docs. All but the last return the columns of ``documents``.

Nulls, empty texts, repeated rows and empty tables go through every stage as its
operator's docstring says; an empty table of documents gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agendum.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from agendum.llm.storage import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model is fitted on ``labels``."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many documents share."""
    return line_dedup.without_common_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return ngram_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their token ids."""
    import public_tokenizers     # only this stage needs it
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

# No SQL expresses the string kernel, the tokenizer or the curve.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
