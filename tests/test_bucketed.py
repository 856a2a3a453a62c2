"""U1 on a bucketed base: the same rows as the plain upsert, and no shuffle of the base."""

from __future__ import annotations

import os
import re
import uuid

import pytest

from agendum.operators.relational import upsert
from agendum.session import checkpoint_dir
from agendum.sinks.bucketed import KEEP_VERSIONS, BucketedTable
from tests.conftest import rows_of

SCHEMA = "ticket_id string, status string, title string, n long"
BASE = [(f"t{i}", "TODO", f"title {i}", i) for i in range(3000)] + [("odd", None, None, None)]
CHANGES = [(f"t{i}", "DONE", None, None) for i in range(0, 3000, 300)] + [("new", "TODO", "fresh", 1), ("odd", "DONE", "x", None)]


@pytest.fixture
def table(spark):
    run = uuid.uuid4().hex
    t = BucketedTable(spark, f"u1_{run}", f"{checkpoint_dir(spark)}/u1-{run}", ["ticket_id"], 8)
    t.create(spark.createDataFrame(BASE, SCHEMA))
    return t


def test_equals_the_plain_upsert_and_replays(spark, table):
    base, changes = spark.createDataFrame(BASE, SCHEMA), spark.createDataFrame(CHANGES, SCHEMA)
    want = rows_of(upsert(base, changes, ["ticket_id"], ["status"]))
    assert rows_of(table.upsert(changes, ["status"], 1)) == want
    assert rows_of(table.upsert(changes, ["status"], 1)) == want        # the micro-batch again
    assert rows_of(table.upsert(changes, ["status"], 2)) == want        # idempotent


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_only_the_changes_are_shuffled(spark, table, adaptive):
    changes = spark.createDataFrame(CHANGES, SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        for version in (1, 2):      # a version written by an upsert is as good a base as the first
            plan = table.merged(changes, ["status"], version)._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
            above_base = plan[:plan.index("FileScan parquet")]
            assert "Bucketed: true" in plan and "Exchange" not in above_base
            table.upsert(changes, ["status"], version)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_one_file_a_bucket_and_old_versions_go(spark, table):
    changes = spark.createDataFrame(CHANGES, SCHEMA)
    for version in range(1, KEEP_VERSIONS + 2):
        table.upsert(changes, ["status"], version)
    kept = sorted(os.listdir(table.target))
    assert kept == [f"v={v}" for v in range(2, KEEP_VERSIONS + 2)]
    files = [f for f in os.listdir(f"{table.target}/{kept[-1]}") if f.endswith(".parquet")]
    assert len(files) == table.buckets


def test_a_version_of_an_earlier_session_is_named_again(spark, table):
    changes = spark.createDataFrame(CHANGES, SCHEMA)
    want = rows_of(table.read(0))
    spark.sql(f"DROP TABLE {table.table(0)}")                            # external: its files stay
    again = table.register(spark.createDataFrame([], SCHEMA), 0)
    assert rows_of(again) == want
    plan = table.merged(changes, ["status"], 1)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_empty_base_and_empty_changes(spark):
    run = uuid.uuid4().hex
    t = BucketedTable(spark, f"u1_{run}", f"{checkpoint_dir(spark)}/u1-{run}", ["ticket_id"], 8)
    t.create(spark.createDataFrame([], SCHEMA))
    assert t.upsert(spark.createDataFrame([], SCHEMA), ["status"], 1).count() == 0
    assert t.upsert(spark.createDataFrame(CHANGES, SCHEMA), ["status"], 2).count() == len(CHANGES)
