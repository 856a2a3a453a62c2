"""Registered queries: the contract's columns on the smallest tables, and SQL."""

from __future__ import annotations

import __spark_entry__ as E
import pytest
from agendum.llm import queries as Q
from agendum.plans.compare import compare, duck_connection

COLUMNS = {
    "op1": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2": {"doc_id": "bigint", "item_id": "bigint", "containment": "double"},
    "op3": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op5": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op6": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op7": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op8": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op9": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op10": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op11": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op12": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op13": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
}


def test_one_query_per_operator():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_contract(spark, sf_dir, name):
    df = Q.QUERIES[name](spark, sf_dir)
    types = dict(df.dtypes)
    assert {c: types[c] for c in COLUMNS[name.split("_")[0]]} == COLUMNS[name.split("_")[0]]
    rows = df.toArrow()
    if name in Q.ORACLE:
        assert compare(rows, duck_connection(sf_dir).sql(Q.ORACLE[name]).to_arrow_table()) == []
    elif not name.startswith(("op1_", "op2_", "op13_")):
        assert rows.num_rows == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
