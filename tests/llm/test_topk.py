from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from agendum.llm import topk
from pyspark.sql import functions as F


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, block string")


def brute(rows, k, every):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine[i, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = True
    out = []
    for qi, qv in fine:
        if qi % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in fine if i != qi)[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def found(spark, rows, k=5, every=5):
    return sorted(tuple(r) for r in topk.top_k(vectors_of(spark, rows), F.col("vec_id") % every == 0, k).collect())


def test_equals_brute_force_with_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_ROWS", 11)
    rng = random.Random(13)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(16)]) for i in range(220)]
    rows += [(300 + i, rows[7][1]) for i in range(70)]       # one common vector
    rows += rows[:20]                                          # repeated rows
    assert found(spark, rows) == brute(rows, 5, 5)
    assert found(spark, rows, k=1, every=3) == brute(rows, 1, 3)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [0.5, 0.5]), (1, [1.0, float("nan")]), (2, [float("inf"), 0.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [0.25, -0.5]), (6, [-1.0, 0.0]), (7, [0.1])]
    assert found(spark, rows) == brute(rows, 5, 5)


def test_fewer_rows_than_k_and_empty_table(spark):
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [1.0]), (1, [0.5])]) == [(0, 1, 1, 256 * 128)]
    assert found(spark, []) == []


def test_all_zero_and_large_components(spark):
    rows = [(0, [0.0, 0.0]), (1, [0.0, 0.0]), (5, [3e5, 1.0]), (6, [3e5, -2.0]), (7, [2.5e5, 3.0])]
    assert found(spark, rows) == brute(rows, 5, 5)


def opened(ids, x):
    lists = pa.array([[int(c) for c in row] for row in x], pa.list_(pa.int64()))
    r = topk._block((pa.scalar(0),), pa.table({"vec_id": pa.array(ids, pa.int64()), "v": lists})).to_pylist()[0]
    return topk.Block(*[r[p] for p in topk.PARTS])


def clustered(n, seed=1, dims=64, groups=60):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (groups, dims))
    return np.floor((centre[rng.integers(0, groups, n)] + rng.normal(0, 0.2, (n, dims))) * 256).astype(int)


def test_queries_stop_on_proof_before_the_last_segment():
    """Clustered vectors: the median query is proven with less than 60 % of the
    products (1 - (1 - steps / levels)^2) and its result equals the whole scores."""
    x = clustered(3000)
    ids = np.arange(3000)
    q, v, s, steps = topk.search_block(opened(ids, x), opened(ids[:200], x[:200]), np.full(200, -np.inf), 5)
    for k in range(200):
        scores = (x @ x[k]).astype(float)
        scores[k] = -np.inf
        best = np.lexsort((ids, -scores))[:5]
        assert v[q == k].tolist() == best.tolist() and s[q == k].tolist() == scores[best].astype(int).tolist()
    assert np.median(1 - (1 - steps / topk.LEVELS) ** 2) < 0.6


def test_floors_stop_other_blocks_sooner():
    x = clustered(3000)
    ids = np.arange(3000)
    asked, block = opened(ids[:200], x[:200]), opened(ids[1500:], x[1500:])
    scores = x[:200] @ x.T
    np.fill_diagonal(scores, np.iinfo(int).min)
    floors = np.sort(scores, axis=1)[:, -5].astype(float)
    q, v, s, _ = topk.search_block(block, asked, floors, 5)
    want = {(a, b) for a in range(200) for b in range(1500, 3000) if scores[a, b] >= floors[a]}
    assert want <= set(zip(q.tolist(), v.tolist(), strict=True))
    assert len(topk.search_block(block, asked, np.full(200, np.inf), 5)[0]) == 0


def test_pairs_of_blocks_that_cannot_serve_are_left_out(spark, monkeypatch):
    """Queries are long vectors of one direction; most others are far too short."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    rng = random.Random(3)
    rows = [(i, [1.0 + rng.random(), 0.5]) for i in range(0, 300)] + [(1000 + i, [0.01, 0.0]) for i in range(300)]
    seen = topk._found(vectors_of(spark, rows), F.col("vec_id") % 50 == 0, 3, 256)
    assert found(spark, rows, k=3, every=50) == brute(rows, 3, 50)
    assert seen.count() < 18 * 15 * 3


def test_long_vectors_cost_their_own_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(1000 + i, [rng.gauss(0, 0.1) for _ in range(200_000)]) for i in (0, 1, 5)]
    assert found(spark, rows, every=20) == brute(rows, 5, 20)


def test_one_vec_id_with_many_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    rng = random.Random(5)
    rows = [(7 if i % 3 else 50 * i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    assert found(spark, rows, every=50) == brute(rows, 5, 50)
