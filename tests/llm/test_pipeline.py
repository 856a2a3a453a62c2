from __future__ import annotations

import random

import corpus_pipeline
import public_tokenizers
import pytest
from agendum.llm import packing
from tests.llm.helpers import components, docs_of


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small corpus in which each stage has something to do, and what should be left."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices(["ka", "lo", "mir", "ten", "sa", "ru", "del"], k=3))
    line = lambda n: " ".join(word() for _ in range(n))
    item = line(20)
    texts, labels, bad, leaks = [], [], set(), set()
    for d in range(400):
        lines = [line(12) for _ in range(4)]
        if d % 5 == 0:
            lines.insert(1, "Subscribe to our newsletter")
        if d % 4 == 0:
            lines[2] = lines[2] + " idiot " + line(3) + " moron"
            bad.add(d)
        if d % 17 == 1 and d not in bad:
            lines[0] += " " + item
            leaks.add(d)
        texts.append((d, "\n".join(lines)))
        labels.append((d, 1, int(d in bad)))
    copies = [(400 + i, texts[3][1] + f" tail{i}") for i in range(8)] + [(430, None), (431, ""), (431, "")]
    folder = tmp_path_factory.mktemp("sf")
    docs_of(spark, texts + copies).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts + copies, bad, leaks


def test_stage_by_stage(spark, sf):
    folder, pairs, bad, leaks = sf
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    expected = {d: t for d, t in pairs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, folder), "test")
        assert docs.columns == columns
        if name == "toxicity":
            expected = {d: t for d, t in expected.items() if d not in bad}
        elif name == "line_dedup":
            holders = {}
            for d, t in expected.items():
                for x in set((t or "").split("\n")) - {""}:
                    holders[x] = holders.get(x, 0) + 1
            assert holders["Subscribe to our newsletter"] >= 10
            expected = {d: t and "\n".join(x for x in t.split("\n") if holders.get(x, 0) < 10) for d, t in expected.items()}
        elif name == "ngram_jaccard_join":
            groups = components(list(expected.items()))
            expected = {d: t for d, t in expected.items() if groups[d][1] == d}
        elif name == "decontamination":
            expected = {d: t for d, t in expected.items() if d not in leaks}
        assert {r.doc_id: r.text for r in docs.collect()} == expected, name
    tok, _ = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, folder).collect()
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    want = {d: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in expected.items()}
    assert got == want | {431: 2 * want[431]}


def test_empty_documents(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
