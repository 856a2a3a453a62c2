"""Letters, marks and punctuation outside Latin."""

from __future__ import annotations

import random

import numpy as np
import pytest

from agendum.llm import toxicity as X
from tests.llm.helpers import docs_of

ALPHABETS = {"cyrillic": (0x430, 32), "greek": (0x3B1, 25), "hebrew": (0x5D0, 27), "arabic": (0x628, 18), "devanagari": (0x915, 36)}


def letters(text):
    raw = text.encode()
    c, start, length, _ = X.units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [c[s:s + n].tolist() for s, n in zip(start, length, strict=True)]


@pytest.mark.parametrize("script", ALPHABETS)
def test_words_of_one_length_are_told_apart(spark, script):
    first, n = ALPHABETS[script]
    rng = random.Random(first)
    word = lambda: "".join(chr(first + rng.randrange(n)) for _ in range(6))
    bad, clean = [word() for _ in range(3)], [word() for _ in range(60)]
    rows, labels = [], []
    for d in range(600):
        toxic = int(d % 4 == 0)
        words = rng.choices(clean, k=20) + toxic * [rng.choice(bad)]
        rng.shuffle(words)
        rows.append((d, " ".join(words)))
        labels.append((d, 1, toxic))
    docs = docs_of(spark, rows)
    model = X.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held = X.score(docs, model).where(X.held_out()).collect()
    assert len(held) > 100
    assert sum((r.score >= X.THRESHOLD) == (r.doc_id % 4 == 0) for r in held) / len(held) >= 0.97


def test_alphabets_have_a_code_a_letter():
    for first, n in ALPHABETS.values():
        assert len({tuple(letters(chr(first + k))[0]) for k in range(n)}) >= n - 3    # accented ones fold
    assert letters("痴漢") != letters("東京") and letters("바보") != letters("나무")
    assert letters("\U00020000") != letters("\U00020001")


def test_marks_punctuation_and_spaces():
    plain = letters("moron")
    for text in ["mo—ron", "“moron”", "mo…ron", "mo​ron", "mo。ron", "móron", "ｍｏron", "m️oron", "moron\U000e0041", "moron™"]:
        assert letters(text) == plain
    assert letters("moron　moron") == letters("moron moron") == letters("moron moron") == plain * 2
    assert letters("Ё") == letters("е") == letters("ё") and letters("かく") != letters("がく")
    assert max(X.FOLD[X.FOLD != X.SPACE]) < X.START < X.END < X.ABC < X.SPACE
