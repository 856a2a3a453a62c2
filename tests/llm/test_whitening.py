from __future__ import annotations

import math

import numpy as np
import pytest
from agendum.llm import whitening as J

SCHEMA = "vec_id long, embedding array<float>, label int, n int, whitened string, component string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, 1, "x", None) for i, v in rows], SCHEMA)


def integers(rows, dims):
    return [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (dims - len(v)) for _, v in rows]


def check(spark, rows, kept, k=32):
    got = J.by_component(vectors_of(spark, rows), k).collect()
    dims = max(len(v) for _, v in kept)
    x = integers(kept, dims)
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    z = np.array([[n * a - b for a, b in zip(r, s, strict=True)] for r in x], float) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(k, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == n * rank and {r["n"] for r in got} == {n}
    want = {}
    for (i, _), r in zip(kept, x, strict=True):
        want.setdefault(i, []).append(sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)))
    for c in range(1, rank + 1):
        mine = sorted((r for r in got if r["component"] == c), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], r["whitened"]))
        w = np.array([r["whitened"] for r in mine])
        assert abs(w.mean()) < 1e-9 and abs((w * w).mean() - 1) < 1e-9
        assert mine[0]["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
        assert mine[0]["identity_error"] < 1e-9
    seen = {}
    for r in got:
        if r["component"] == 1:
            seen.setdefault(r["vec_id"], []).append(int(r["deviation"]))
    assert {i: sorted(v) for i, v in seen.items()} == {i: sorted(v) for i, v in want.items()}
    by_vector = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    for c in range(rank):       # directions, where eigenvalues stand apart
        near = min([abs(values[c] - values[o]) for o in (c - 1, c + 1) if 0 <= o < len(values)] or [1])
        if near > 1e-3 * values[0] and len(by_vector) == n * rank:
            w = np.array([by_vector[i, c + 1] for i, _ in kept])
            p = z @ vectors[:, c] / math.sqrt(values[c])
            assert min(np.abs(w - p).max(), np.abs(w + p).max()) < 1e-8


def test_equals_dense_solution(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=48) * 0.9 ** np.arange(48) * 0.3 + 0.1) for i in range(700)]
    check(spark, rows, rows)


def test_rows_that_are_dropped_and_short_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6)) for i in range(40)]
    odd = [(90, None), (91, [1.0, None]), (92, [float("nan")] * 6), (93, [float("inf")] + [0.0] * 5)]
    more = [(None, rng.normal(size=6)), (7, rows[7][1]), (95, []), (96, [0.5, 1.5])]
    check(spark, rows + odd + more, rows + more, k=4)


def test_rank_deficient_equal_single_and_no_vectors(spark):
    rows = [(i, [i % 5, (i % 5) * 2.0, 1.0]) for i in range(20)]
    check(spark, rows, rows)
    assert J.by_component(vectors_of(spark, [(1, [0.5, 0.25])])).count() == 0
    assert J.by_component(vectors_of(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).count() == 0
    assert J.by_component(vectors_of(spark, [(1, None)])).count() == 0
    assert J.whiten(vectors_of(spark, []))[0].collect() == []


def test_large_entries_are_exact(spark):
    rows = [(i, [3e7 * i, -2e8 + i, 0.0]) for i in range(9)]
    got = {r["vec_id"]: int(r["_deviation"]) for r in J.whiten(vectors_of(spark, rows))[0].collect()}
    x = integers(rows, 3)
    s = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i: sum((9 * a - b) ** 2 for a, b in zip(r, s, strict=True)) for i, r in enumerate(x)}


@pytest.mark.parametrize("spectrum", ["decay", "clustered", "flat"])
def test_jacobi_davidson_below_the_full_space(spectrum):
    """A subspace that never reaches the whole space, with MINRES corrections."""
    rng = np.random.default_rng(3)
    dims = 400
    q, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
    e = {"decay": 0.97 ** np.arange(dims), "clustered": np.where(np.arange(dims) < 5, 2, 1 - 1e-3 * np.arange(dims)),
         "flat": 1 + rng.random(dims)}[spectrum]
    a = q * e @ q.T
    widths = []

    def product(block):
        widths.append(block.shape[1])
        return a @ block
    values, vectors, residuals = J.leading_pairs(product, dims, 10)
    assert np.allclose(values, np.sort(e)[::-1][:10], atol=1e-12) and residuals.max() <= J.TOLERANCE * e.max()
    assert np.abs(vectors.T @ vectors - np.eye(10)).max() < 1e-12
    assert min(widths) < 10        # converged pairs were locked


def test_minres_solves_symmetric_systems():
    rng = np.random.default_rng(5)
    m = rng.normal(size=(30, 30))
    a = m + m.T
    b = rng.normal(size=(30, 3))
    assert np.allclose(a @ J.minres(lambda v: a @ v, b, 60, 1e-13), b, atol=1e-8)
