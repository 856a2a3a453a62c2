from __future__ import annotations

import hashlib
import random

import pytest
from agendum.llm import suffix_dedup as S
from pyspark.sql import functions as F

from tests.llm.helpers import docs_of, odd_texts


def brute(pairs, width=50):
    """Per row: (doc_id, bytes, removed, spans, sha256), by a table of every string's least doc_id."""
    first = {}
    for d, t in pairs:
        data = (t or "").encode()
        if d is not None:
            for i in range(len(data) - width + 1):
                s = data[i:i + width]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t in pairs:
        data = (t or "").encode()
        gone = bytearray(len(data) + 1)
        end = 0
        for i in range(len(data) - width + 1):
            if d is not None and first[data[i:i + width]] < d:
                a = max(i, end)
                end = i + width
                gone[a:end] = b"\1" * (end - a)
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((d, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, pairs, clash=False, **kw):
    got = S.remove_repeats(docs_of(spark, pairs, clash=clash), **kw)
    return sorted((tuple(r) for r in got.select("doc_id", "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256").collect()), key=repr)


def corpus(seed, n=60):
    """Passages shared by many texts, cut and edited at random places."""
    rng = random.Random(seed)
    word = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    prose = lambda k: " ".join(rng.choice(word) for _ in range(k))
    shared = [prose(rng.randint(8, 60)) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = prose(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a, b = sorted(rng.sample(range(len(s) + 1), 2))
            t += s[a:b] + prose(rng.randint(0, 4))
        texts.append(t)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    pairs = list(enumerate(corpus(seed)))
    random.Random(seed).shuffle(pairs)
    assert found(spark, pairs) == brute(pairs)


def test_hot_keys_and_shuffled_joins(spark, monkeypatch):
    pairs = list(enumerate(corpus(3)))
    pairs += [(100 + i, "the very same opening line of every text, said again and again. " + t) for i, t in enumerate(corpus(4, 30))]
    want = brute(pairs)
    monkeypatch.setattr(S, "HOT", 5)
    assert found(spark, pairs) == want
    monkeypatch.setattr(S, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(S, "MAX_BROADCAST_BYTES", -1)
    monkeypatch.setattr(S, "RUN_ROWS", 7)
    monkeypatch.setattr(S, "CHUNK", 11)
    assert found(spark, pairs) == want


def test_odd_texts_repeats_and_clashing_names(spark):
    base = corpus(5, 12)
    period = "abc" * 400
    pairs = list(enumerate(odd_texts() + base + base[:4] + [period, period + "z", "q" * 700, "q" * 49, "q" * 50]))
    pairs += [(None, base[0]), (None, None), (3, base[1] * 2), (3, base[1]), pairs[20], pairs[20]]
    assert found(spark, pairs, clash=True) == brute(pairs)


def test_only_smaller_documents_count(spark):
    s = "0123456789" * 5
    pairs = [(1, s + "x" + s), (2, "ab" + s), (2, "cd" + s), (0, "y" + s[:49])]
    got = {r[0:4:3] + r[2:3] for r in found(spark, pairs)}
    assert got == {(1, 0, 0), (2, 1, 50), (0, 0, 0)}


def test_kept_bytes_and_spans(spark):
    a = "A passage of clearly more than fifty bytes that is repeated elsewhere."
    rows = S.remove_repeats(docs_of(spark, [(1, a), (2, "Before. " + a + " After."), (3, a)])).orderBy("doc_id").collect()
    assert [bytes(r["_kept"]) for r in rows] == [a.encode(), b"Before.  After.", b""]
    assert [[(s["start"], s["end"]) for s in r["_spans"]] for r in rows] == [[], [(8, 8 + len(a))], [(0, len(a))]]


def test_empty_table(spark):
    assert found(spark, []) == []
    assert S.remove_repeats(docs_of(spark, [(1, "x")]).where(F.lit(False))).count() == 0
