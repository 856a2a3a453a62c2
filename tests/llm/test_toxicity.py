from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from agendum.llm import toxicity as X
from tests.llm.helpers import docs_of, odd_texts

BAD = ["idiot", "moron", "scum", "grumkopf", "grumlich", "grumheit", "zaplotte"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    syllables = ["ka", "lo", "mir", "ten", "sa", "ru", "del", "no", "vi", "the", "an", "or", "id", "mo", "cu"]
    rows, labels = [], []
    for d in range(900):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(rng.randrange(20, 120))]
        toxic = int(d % 4 == 0)
        for _ in range(toxic * rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((d, " ".join(words)))
        labels.append((d, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark, corpus):
    return X.train(docs_of(spark, corpus[0]), spark.createDataFrame(corpus[1], "doc_id long, quality int, toxic int"))


def probability(model, text):
    raw = text.encode()
    return float(model.probability(X.worst_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), model))[0])


def test_held_out_accuracy(spark, corpus, model):
    truth = {d: t for d, _, t in corpus[1]}
    rows = X.score(docs_of(spark, corpus[0]), model).select("doc_id", "score", X.held_out().alias("held_out")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 150
    right = sum((r.score >= X.THRESHOLD) == bool(truth[r.doc_id]) for r in held)
    assert right / len(held) >= 0.97


@pytest.mark.parametrize("word", ["idiot", "i.d.i.o.t", "i d i o t", "id1ot", "IDIOT!", "idioot", "mo-ron", "m*o*r*o*n", "sc_um", "grumkopfx"])
def test_gapped_and_inserted_characters(model, word):
    assert probability(model, f"kalo mir ten {word} delno vi") >= X.THRESHOLD


def test_clean_words_stay_clean(model):
    assert probability(model, "kalo mir tensaru delno vi the anor midel cumo") < X.THRESHOLD


def test_odd_texts_and_clashing_columns(spark, model):
    docs = docs_of(spark, odd_texts(), clash=True)
    rows = X.score(docs, model, "tox").collect()
    assert len(rows) == docs.count() and all(0 <= r.tox <= 1 for r in rows)
    by_id = {r.doc_id: r.tox for r in rows}
    assert by_id[0] == by_id[1] == by_id[2] == by_id[10] < X.THRESHOLD and by_id[11] == by_id[12]


def test_no_labels_of_one_class_and_empty_tables(spark):
    docs = docs_of(spark, ["a b", "c d"])
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert [r.score for r in X.score(docs, X.train(docs, labels)).collect()] == pytest.approx([0, 0], abs=1e-9)
    none = docs_of(spark, [])
    assert X.score(none, X.train(none, labels)).count() == 0


def test_without_toxic_keeps_columns(spark, corpus):
    labels = spark.createDataFrame(corpus[1], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [*corpus[0], (None, "what an idiot he is"), (None, None)], clash=True)
    kept = X.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    gone = 902 - kept.count()
    assert 215 <= gone <= 235


def test_kernel_weights_follow_the_definition():
    """Scores by folded weights equal the sum over letter triples written out."""
    letters = np.array([9, 4, 9, 15, 20], np.uint8)
    rng = np.random.default_rng(0)
    weights = rng.normal(size=X.ABC ** 3).astype(np.float32)
    got = X.raw_scores(letters, np.array([0]), np.array([5]), weights, 0.25)[0]
    full = [X.START, *letters.tolist(), X.END]
    total = norm = 0.0
    for i in range(len(full)):
        for j in range(i + 1, len(full)):
            for k in range(j + 1, len(full)):
                if k - i < X.REACH:
                    w = X.DECAY ** (k - i - 2)
                    total += w * weights[full[i] * X.ABC ** 2 + full[j] * X.ABC + full[k]]
                    norm += w * w
    assert got == pytest.approx(total / norm ** 0.5 + 0.25, rel=1e-5)
