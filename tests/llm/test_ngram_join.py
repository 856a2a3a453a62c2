from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
from agendum.llm import ngram_join
from agendum.llm.storage import Cuts, shared_dir
from pyspark.sql import functions as F
from tests.llm.helpers import components, docs_of, odd_texts


def as_map(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_equals_brute_force_on_copies_edits_and_chains(spark):
    rng = random.Random(3)
    texts = []
    for length in (6, 12, 30, 80, 200):
        base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        texts += [edited(rng, base, rng.randrange(1 + length // 20)) for _ in range(12)]
        texts += [" ".join(base), " ".join(base).upper()]
        chain = list(base)      # neighbours link, ends don't
        for _ in range(8):
            chain = chain[:1] + [f"c{rng.randrange(10**6)}"] + chain[2:] if length > 30 else chain
            chain = chain[length // 12:] + [f"t{rng.randrange(10**6)}" for _ in range(length // 12)]
            texts.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))) for _ in range(40)]
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    assert as_map(ngram_join.near_duplicates(docs_of(spark, pairs, clash=True).repartition(6))) == components(pairs)


def test_odd_texts(spark):
    pairs = list(enumerate(odd_texts()))
    got = as_map(ngram_join.near_duplicates(docs_of(spark, pairs)))
    assert got == components(pairs)
    assert got[0] == (0, 0) and got[1] == (0, 1)    # null and empty are linked with nothing


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "alone in the world it is"), (9, "")]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (None, None), (9, 9)], key=str)


def test_empty_table(spark):
    assert ngram_join.near_duplicates(docs_of(spark, [])).count() == 0


def test_a_large_group_makes_few_pairs(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    pairs = [(i, edited(rng, base, 1)) for i in range(400)]
    got = as_map(ngram_join.near_duplicates(docs_of(spark, pairs).repartition(4)))
    assert got == components(pairs)


def test_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (7, "quite another text than that one"), (8, ""), (8, ""), (None, "x y z"), (2, None)]
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in ngram_join.one_of_each(docs_of(spark, rows, clash=True)).collect())
    assert kept == [(False, 1, "a b c d e f"), (False, 2, ""), (False, 7, "quite another text than that one"), (False, 8, ""), (False, 8, ""), (True, 0, "x y z")]
    assert ngram_join.one_of_each(docs_of(spark, rows, clash=True)).columns == docs_of(spark, rows, clash=True).columns


def test_least_overlap_is_the_jaccard_threshold():
    for n in range(1, 60):
        for m in range(1, 60):
            least = int(ngram_join.least_overlap(n, m, 80))
            assert 100 * least >= 80 * (n + m - least)
            assert 100 * (least - 1) < 80 * (n + m - least + 1)


def test_counters_grow_with_the_text_and_keep_large_counts(spark):
    small, large = docs_of(spark, ["a" * 100]), docs_of(spark, ["a" * 40_000_000])
    assert ngram_join.counter_bits(small) == ngram_join.counter_bits(docs_of(spark, [])) == ngram_join.BLOCK_BITS
    assert 2 ** ngram_join.counter_bits(large) * ngram_join.COUNTER_BYTES >= 40_000_000
    one = pa.RecordBatch.from_arrays([pa.array(["one two three four five"] * 70_000)], names=["text"])
    rows = pa.Table.from_batches(list(ngram_join._count(iter([one]), 5, ngram_join.BLOCK_BITS)))
    assert rows.column("place").to_pylist() == [0, 8, 16]       # 70,000 takes three bytes
    levels = np.frombuffer(ngram_join._levels((pa.scalar(0),), rows).column("levels")[0].as_buffer(), "<u2")
    assert levels.max() == ngram_join.rank_levels(np.array([70_000]))[0] and np.count_nonzero(levels) == 1


def test_pairs_are_verified_exactly(spark):
    sets = [([1, 2, 3, 4], [1, 2, 3, 4, 5]), ([1, 2, 3, 4], [1, 2, 3, 5]), ([7], [7]), ([7], [8])]
    rows = spark.createDataFrame(sets, "x array<long>, y array<long>")
    got = [r.ok for r in rows.select(ngram_join.overlap_enough(F.col("x"), F.col("y"), 80).alias("ok")).collect()]
    assert got == [True, False, True, False]


def test_replaced_tables_are_removed(spark):
    cuts = Cuts(spark)
    first = cuts.cut(spark.range(10), "cuts-test")
    second = cuts.cut(first.groupBy((F.col("id") % 3).alias("k")).count(), "cuts-test")
    cuts.drop(first, None)
    assert {r["k"]: r["count"] for r in second.collect()} == {0: 4, 1: 3, 2: 3}
    left = [x for x in os.listdir(f"{shared_dir(spark).removeprefix('file:')}/agendum") if x.startswith("cuts-test")]
    assert len(left) == 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_components_of_stars_take_no_step_and_chains_end_at_their_smallest_node(spark, monkeypatch):
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    written = []
    cut = Cuts.cut
    monkeypatch.setattr(Cuts, "cut", lambda self, df, name: written.append(name) or cut(self, df, name))
    found = lambda rows: {r.u: r.v for r in ngram_join.star_components(Cuts(spark), edges(rows)).collect()}
    assert found([(1, i) for i in range(2, 40)] + [(60, 50), (50, 51), (51, 50), (7, 7)]) == {i: 1 for i in range(2, 40)} | {60: 50, 51: 50}
    assert written == ["components"]     # the edges alone, and no step to see that nothing changes
    assert found([]) == {}
    assert len(written) == 2
    rng = random.Random(4)
    chain = list(range(100, 130))
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:], strict=False)) + [(rng.randrange(30), rng.randrange(30)) for _ in range(25)]
    want = {x: x for pair in pairs for x in pair}
    for _ in want:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert found(pairs) == {x: c for x, c in want.items() if c != x}


def test_broadcasts_of_finished_joins_are_let_go(spark):
    docs = docs_of(spark, [f"{k} one two three four five six seven {k % 3}" for k in range(30)])
    kept = []
    release = Cuts.release
    try:
        Cuts.release = lambda self: kept.append(1) or release(self)
        ngram_join.near_duplicates(docs).collect()
    finally:
        Cuts.release = release
    assert len(kept) >= ngram_join.ROUNDS + 2     # after each join of components
