from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from agendum.llm import divergence as D
from pyspark.sql import functions as F

from tests.llm.helpers import AZ

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, total long, place string"


def docs_of(spark, rows):
    """Documents from (text, lang, source), with columns of clashing names."""
    return spark.createDataFrame([(i, t, lg, s, "x", 1, 2, None) for i, (t, lg, s) in enumerate(rows)], SCHEMA)


def brute(rows, least, k=50):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    rows = [(terms(t), lg or "", s or "") for t, lg, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == lang]
        docs = Counter(w for r in mine for w in set(r[0]))
        kept = {w for w, c in docs.items() if c >= least}
        count = {s: Counter(w for r in mine if r[2] == s for w in r[0] if w in kept) for s in {r[2] for r in mine}}
        whole = sum(count.values(), Counter())

        def share(c, w, v=len(kept)):
            return 1 + 10 ** 9 * (c[w] + 5) // (sum(c.values()) + 5 * v)

        for s in count:
            pair = [(-sum(abs(share(count[s], w) - share(count[o], w)) for w in kept), o.encode()) for o in count if o != s]
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(sorted(pair))]
            best = [(share(whole, w) - share(count[s], w), w.encode()) for w in count[s]]
            best = sorted(x for x in best if x[0] < 0)[:k]
            out += [(lang, s, "term", w.decode(), -v, i + 1) for i, (v, w) in enumerate(best)]
    return sorted(out)


def found(spark, rows, **kw):
    return sorted(tuple(r) for r in D.audit(docs_of(spark, rows), **kw).collect())


def corpus(seed, n=250, sources=7):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéZz日") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        s = int(rng.random() ** 2 * sources)
        pick = lambda: words[int(rng.random() ** (1 + s / 3) * len(words))]
        rows.append((rng.choice([" ", "1", "\n"]).join(pick() for _ in range(rng.randint(0, 60))), "xy"[i % 3 == 0], f"s{s}"))
    return rows


@pytest.mark.parametrize("k", [50, 3])
def test_equals_brute_force(spark, k):
    rows = corpus(k)
    assert found(spark, rows, min_documents=4, k=k) == brute(rows, 4, k)


def test_blocks_of_sources_and_hash_parts(spark, monkeypatch):
    rows = corpus(8, sources=9)
    monkeypatch.setattr(D, "PART_ROWS", 100)
    monkeypatch.setattr(D, "STEP_TERMS", 7)
    assert found(spark, rows, min_documents=3) == brute(rows, 3)


def test_tiles():
    import pyarrow as pa
    rng = np.random.default_rng(4)
    rows = [(f"t{w}", s, int(rng.integers(1, 99))) for w in range(40) for s in (0, 3, 300, 301, 500) if rng.random() < 0.5]
    base = {0: 5, 3: 6, 300: 7, 301: 8, 500: 9}
    every = rows + [(None, p, b) for p, b in base.items()]
    table = pa.table({"term": [r[0] for r in every], "place": pa.array([r[1] for r in every], pa.int32()), "share": pa.array([r[2] for r in every], pa.int64())})
    got = D._tile_sums((pa.scalar("x"), pa.scalar(0), pa.scalar(1), pa.scalar(0)), table).to_pylist()
    value = {(r[0], r[1]): r[2] for r in rows}
    names = {r[0] for r in rows}
    for g in got:
        assert g["total"] == sum(abs(value.get((w, g["a"]), base[g["a"]]) - value.get((w, g["b"]), base[g["b"]])) for w in names)
    assert {(g["a"], g["b"]) for g in got} == {(a, b) for a in (0, 3) for b in (300, 301, 500)}


@pytest.mark.parametrize("k", [1, 4, 50])
def test_skyband_equals_counting(k):
    rng = np.random.default_rng(k)
    n, lang_n, name = rng.integers(0, 30, 900), rng.integers(0, 30, 900), rng.permutation(900)
    above = [(np.count_nonzero((n >= n[i]) & (lang_n <= lang_n[i]) & (name <= name[i]))) - 1 for i in range(900)]
    assert sorted(D.skyband(n, lang_n, name, k)) == [i for i in range(900) if above[i] < k]


def test_nulls_ties_repeats_and_long_texts(spark):
    long = " ".join(f"w{'abc'[i % 3]}{'xyz'[i % 7 % 3]}" for i in range(60_000))
    rows = [(None, "en", "a"), ("", None, "a"), ("alpha beta", "en", None), ("Alpha BETA", "en", None), ("alpha beta", "en", "b"),
            (long, "en", "b"), (long, "en", "c"), ("ÉCOLE école", "en", "c"), ("only here", "de", "z"), ("alpha", None, None), ("alpha", None, None)]
    assert found(spark, rows, min_documents=2) == brute(rows, 2)
    assert found(spark, rows, min_documents=30) == brute(rows, 30)     # no kept terms: pairs of value 0


def test_empty_table(spark):
    assert D.audit(docs_of(spark, [("x", "en", "a")]).where(F.lit(False))).collect() == []
