from __future__ import annotations

import hashlib
import random

from agendum.llm import line_dedup as L
from tests.llm.helpers import AZ, docs_of, odd_texts


def brute(pairs, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(AZ)
    holders = {}
    for d, t in pairs:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add((d, t))
    common = {k for k, ds in holders.items() if k and len(ds) >= min_docs}
    out = []
    for d, t in pairs:
        lines = (t or "").split("\n")
        kept = "\n".join(x for x in lines if key(x) not in common)
        out.append((d, len(lines), sum(key(x) in common for x in lines), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(docs, min_docs, batches=4):
    return sorted(((r.doc_id, r._n_lines, r._n_dropped, hashlib.sha256(r._kept.encode()).hexdigest()) for r in L.dedup_lines(docs, min_docs, batches).collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    pool = [f"Line {i} Éa" for i in range(40)] + ["  Padded\t", "padded", "PADDED \r", "", "   "]
    pairs = []
    for d in range(200):
        lines = [rng.choice(pool[:rng.randrange(1, len(pool))]) for _ in range(rng.randrange(8))] + [f"own {rng.randrange(60)}"]
        rng.shuffle(lines)
        pairs.append((d, "\n".join(lines)))
    pairs += [(1000 + i, t) for i, t in enumerate(odd_texts())]
    docs = docs_of(spark, pairs, clash=True).repartition(5)
    for min_docs, batches in ((10, 4), (3, 7), (2, 1)):
        assert result(docs, min_docs, batches) == brute(pairs, min_docs)


def test_a_line_many_times_in_one_document_counts_once(spark):
    pairs = [(1, "again\n" * 30), (2, "again"), (2, "again"), (None, "again"), (None, None)]
    for n in (3, 4):
        assert result(docs_of(spark, pairs), n) == brute(pairs, n)


def test_empty_table(spark):
    assert result(docs_of(spark, []), 10) == []


def test_runs_are_levelled_and_settled_keys_are_not_added(spark):
    runs = L.Runs(spark, 3, 5)
    batch = spark.range(40).selectExpr("id as d1", "0L as d2", "id % 4 as h1", "0L as h2")
    for n in range(5):
        runs.add(batch)
        sizes = [len(level) for level in runs.levels]
        assert all(s < L.FANOUT for s in sizes)
    # 10 documents a key settle it in the first batch: later batches add nothing.
    assert sum(r.n for run in runs.runs() for r in run.collect()) == 40
    assert runs.common().count() == 4
    # Runs merge without a shuffle.
    plan = runs.merge(runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert len(runs.runs()) > 1 and "FullOuter" in plan and "Exchange" not in plan


def test_without_common_lines_keeps_columns(spark):
    docs = docs_of(spark, [(i, f"shared\nown {i}") for i in range(12)] + [(50, None)], clash=True)
    out = L.without_common_lines(docs)
    assert out.columns == docs.columns and out.count() == 13
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[3].text == "own 3" and rows[3].n_chars == 5 and rows[50].text is None and rows[50].n_chars is None
