"""Word vectors and topics: the driver's share does not grow with the vocabulary,
the tree by count is a Huffman tree, and every row gets its topic."""

from __future__ import annotations

import heapq
import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from agendum.operators import topics as TP
from agendum.operators import word_vectors as W
from tests.conftest import ROOT, rows_of

MANY_WORDS = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config(map={
    "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.driver.maxResultSize": "1m", "spark.driver.memory": "2g",
    "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": sys.argv[1], "spark.local.dir": sys.argv[1]}).getOrCreate()
from agendum.operators.topics import cluster_topics
words = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda j: F.concat(F.lit("w"), ((F.col("id") * 100 + j) % 20000).cast("string")))
df = spark.range(1000).select("id", F.concat_ws(" ", words).alias("text"))
print("rows", cluster_topics(df, k=2).filter("topic IS NOT NULL").count())
"""


def test_vocabulary_is_not_sent_to_the_driver(tmp_path):
    """20,000 words of 100 floats are 8 MB; results of more than 1 MB fail the job."""
    done = subprocess.run([sys.executable, "-c", MANY_WORDS, str(tmp_path)], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT},
                          capture_output=True, text=True, timeout=600)
    assert "rows 1000" in done.stdout, done.stderr[-2000:]


def test_tree_by_count_is_a_huffman_tree():
    rng = random.Random(1)
    for _ in range(200):
        counts = sorted(rng.sample(range(1, 40), rng.randint(1, 12)), reverse=True)
        classes = [(c, rng.choice([1, 1, 2, 3, 7, 20])) for c in counts]
        each = [c for c, n in classes for _ in range(n)]
        tree, least, heap = W.huffman(classes), 0, each[:]
        heapq.heapify(heap)
        while len(heap) > 1:
            heapq.heappush(heap, pair := heapq.heappop(heap) + heapq.heappop(heap))
            least += pair
        up, second = tree.parents(np.arange(2 * len(each) - 1))
        assert up[-1] == -1 and (up[:-1] >= len(each)).all()
        assert len(set(zip(up[:-1].tolist(), second[:-1].tolist()))) == 2 * (len(each) - 1)     # two children a node
        cost, at = 0, np.arange(len(each))
        while (more := up[at] >= 0).any():
            cost += int(np.array(each)[more].sum())
            at = np.where(more, up[at], len(up) - 1)
        assert cost == least


def test_update_is_that_of_one_pair_after_the_other():
    """Within a word's window; other words of the block are seen as they were before it."""
    tree, size = W.huffman([(60 - i, 1) for i in range(50)]), 16
    part, rng = W.Part(tree, np.arange(50), pa.nulls(50, pa.string()), size, 1), np.random.default_rng(0)
    part.word_vec[:], part.node_vec[:] = rng.normal(size=(50, size)) * 0.3, rng.normal(size=(49, size)) * 0.3
    part.word_vec[9] *= 20                                     # beyond MAX_EXP at some nodes
    x, y = part.word_vec.astype(float), part.node_vec.astype(float)
    to_x, to_y, nodes, goals = x.copy(), y.copy(), *part.paths(np.arange(50))
    words = np.array([3, 7, 3, 9, 12, 3, 41])                  # sentences of 6 words and of one

    class Reach:
        def integers(self, low, high, n):
            return np.arange(n) % 5

    part.train(words, np.array([6, 7]), Reach(), 0.025)
    skipped = 0
    for q in range(6):
        on_path = nodes[words[q]] >= 0
        path, goal = nodes[words[q]][on_path], goals[words[q]][on_path]
        seen = y[path].copy()
        for c in range(max(0, q - 5 + q % 5), min(6, q + 6 - q % 5)):
            if c != q:
                f = seen @ x[words[c]]
                g = np.where(abs(f) < W.MAX_EXP, 0.025 * (goal - 1 / (1 + np.exp(-f))), 0)
                skipped += int((g == 0).sum())
                to_x[words[c]] += g @ seen
                seen += g[:, None] * x[words[c]]
        np.add.at(to_y, path, seen - y[path])
    assert skipped and np.allclose(part.word_vec, to_x, atol=2e-4) and np.allclose(part.node_vec, to_y, atol=2e-4)
    assert np.abs(to_x - x).max() > 0.02 and np.flatnonzero(part.seen).tolist() == [3, 7, 9, 12]


def test_vectors_in_a_file_are_those_in_memory(monkeypatch):
    parts = []
    for limit in (W.IN_MEMORY, 0):
        monkeypatch.setattr(W, "IN_MEMORY", limit)
        part = W.Part(W.huffman([(9, 30)]), np.arange(30), pa.nulls(30, pa.string()), 8, 1)
        part.train(np.arange(30), np.array([30]), np.random.default_rng(1), 0.025)
        parts.append(part)
    assert (parts[0].word_vec == parts[1].word_vec).all() and (parts[0].node_vec == parts[1].node_vec).all()
    assert parts[0].node_vec.any()


@pytest.fixture
def two_topics(spark):
    rng = random.Random(7)
    words = [[f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]]
    rows = [(i, i % 2, " ".join(rng.choice(words[i % 2]) for _ in range(40))) for i in range(600)]
    return spark.createDataFrame([*rows, rows[0], rows[0], (None, 0, None), (None, 0, "")], "seq long, kind int, text string")


def test_every_row_gets_the_topic_of_its_words(two_topics):
    out = TP.cluster_topics(two_topics, k=3, size=16, seed=3)
    assert out.columns == ["seq", "kind", "text", "topic"]
    assert rows_of(out, ["seq", "kind", "text"]) == rows_of(two_topics)
    kinds = {}
    for r in out.filter("length(text) > 0").collect():
        kinds.setdefault(r.topic, set()).add(r.kind)
    assert len(kinds) >= 2 and all(len(k) == 1 for k in kinds.values())


def test_same_vectors_again_and_means_over_all_tokens(spark, two_topics, tmp_path):
    fits = [TP.fit_topic_vectors(two_topics, size=8, min_count=1, seed=2, max_iter=n) for n in (2, 2, 0)]
    first, again, untrained = ({r.word: list(r.vec) for r in f.vectors.collect()} for f in fits)
    assert first == again and len(first) == 24 and first.keys() == untrained.keys()
    assert all(abs(x) <= 0.5 / 8 for v in untrained.values() for x in v)
    assert all(first[w] != untrained[w] for w in first)
    texts = spark.createDataFrame([("a1 b1 A1 new",), ("new",), ("",), (None,)], "text string")
    got = {r.text: r.topic_vec.toArray() for r in TP.score_stream(texts, fits[0]).collect()}
    assert np.allclose(got["a1 b1 A1 new"], (2 * np.array(first["a1"]) + np.array(first["b1"])) / 4)
    assert not got["new"].any() and not got[""].any() and not got[None].any() and len(got) == 4
    texts.filter("text IS NOT NULL").write.parquet(str(tmp_path / "in"))
    stream = TP.score_stream(spark.readStream.schema("text string").parquet(str(tmp_path / "in")), fits[0])
    run = stream.writeStream.format("memory").queryName("topic_vectors").trigger(availableNow=True).start()
    run.awaitTermination()
    for r in spark.table("topic_vectors").collect():
        assert np.allclose(r.topic_vec.toArray(), got[r.text])


def test_rows_keep_vectors_of_another_model(two_topics):
    kw = TP.fit_keywords(two_topics.na.fill(""), num_features=16)
    both = TP.score_stream(TP.score_stream(two_topics.na.fill(""), kw), TP.fit_topic_vectors(two_topics, size=8))
    assert {"tfidf_vec", "topic_vec"} <= set(both.columns)
    assert all(r.tfidf_vec.size == 16 and r.topic_vec.size == 8 for r in both.collect())


def test_no_frequent_word_is_an_error(spark):
    with pytest.raises(ValueError, match="no word occurs 5 times"):
        TP.fit_topic_vectors(spark.createDataFrame([("a b",)], "text string"))
