from __future__ import annotations

import random
import re

from agendum.llm import decontamination as D
from tests.llm.helpers import docs_of, odd_texts


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(ws, k):
    return {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)}


def brute(docs, items):
    out = []
    for d, text in docs:
        for i, item in items:
            k = min(5, len(words(item)))
            if k:
                g = grams(words(item), k)
                n = len(g & grams(words(text), k))
                if n * 100 >= len(g) * 80:
                    out.append((d, i, len(g), n))
    return sorted(out, key=str)


def found(spark, docs, items):
    items = spark.createDataFrame(items, "item_id long, text string")
    rows = D.find_items(docs_of(spark, docs, clash=True), items).collect()
    assert all(r.containment == r.n_found / r.n_shingles for r in rows)
    return sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in rows), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 4, 5, 9, 15, 33, 57])))) for i in range(25)]
    docs = []
    for d in range(120):
        ws = rng.choices(vocabulary, k=rng.randrange(3, 400))
        for _ in range(rng.randrange(3)):
            part = words(rng.choice(items)[1])
            cutoff = rng.randrange(len(part) // 4 + 1)
            part = part[cutoff:] if rng.random() < 0.5 else part[:len(part) - cutoff]
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "edit"
            at = rng.randrange(len(ws))
            ws[at:at] = part
        docs.append((d, ", ".join(ws).title()))
    assert found(spark, docs, items) == brute(docs, items)


def test_odd_texts_and_items(spark):
    docs = [*enumerate(odd_texts()), (50, "one two THREE, four!"), (50, "one two THREE, four!"), (None, "one two three four")]
    items = [(0, None), (1, ""), (2, "..."), (3, "one two three four"), (3, "one two three four"), (None, "same text here for all of us"), (4, "word5 tail5 word6 tail6 word7 tail7 word8")]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b c d e f")]) == []
    assert found(spark, [(1, "a b c d e f")], []) == []


def test_sketch_of_every_size_has_a_value_in_any_text_that_qualifies(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n + 4))) for n in (1, 2, 5, 8, 9, 31, 32, 64)]
    sets = D.item_sets(spark.createDataFrame(items, "item_id long, text string"), 5)
    sizes = {r.item_row: r.n for r in sets.collect()}
    count = {}
    for r in D.sketches(sets, 80).collect():
        count.setdefault(r.item_row, [0, r.enough])[0] += 1
    for row, n in sizes.items():
        k, enough = count[row]
        spare = n - -(-n * 80 // 100)
        assert k > spare and enough == max(1, k - spare)


def test_leaking_documents_go(spark):
    docs = docs_of(spark, [(1, "clean text of some words here"), (2, "say: a b c d e f g h, ok"), (None, "a b c d e f g h"), (3, None)], clash=True)
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    kept = D.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_large_sketches_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    test_leaking_documents_go(spark)
