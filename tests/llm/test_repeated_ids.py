"""One doc_id on rows with different texts."""

from __future__ import annotations

from agendum.llm import ngram_join
from tests.llm.helpers import docs_of


def test_one_of_each_keeps_unlinked_texts_of_one_id(spark):
    texts = [f"text{k} " + " ".join(f"w{k}x{i}" for i in range(9)) for k in range(30)]
    rows = [(5, t) for t in texts]                                  # unlinked, one hot id
    rows += [(5, texts[0]), (9, texts[1])]                          # copies of two of them
    rows += [(1, "a b c d e f g h"), (6, "a b c d e f g h"), (6, "one more text that stands alone"), (6, ""), (6, None)]
    docs = docs_of(spark, rows, clash=True)
    kept = ngram_join.one_of_each(docs.repartition(3))
    want = [(5, t) for t in texts] + [(1, "a b c d e f g h"), (6, "one more text that stands alone"), (6, ""), (6, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
