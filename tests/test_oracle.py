"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from agendum.plans import registry
from agendum.plans.compare import compare, duck_connection
from agendum.plans.registry import load_all

load_all()     # the engine's own queries; those of optional subpackages have tests of their own
QUERIES, ORACLE = dict(registry.QUERIES), dict(registry.ORACLE)


@pytest.fixture(scope="module")
def duck(sf_dir):
    return duck_connection(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 70


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"window_start", "meeting_id", "productivity_score"} <= set(df.columns)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    s_tbl = QUERIES[name](spark, sf_dir).toArrow()
    d_tbl = duck.sql(ORACLE[name]).to_arrow_table()
    assert compare(s_tbl, d_tbl) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name, column", [
    ("status_intent", "intent"), ("detect_assignee", "assignee_id"), ("check_orphans", "orphan_rows"), ("check_domain", "violations"),
    ("apply_ticket_updates", "reject_reason"), ("patch_tickets", "status_updates"), ("meeting_state", "ended"), ("rejected_messages", "reject_reason"),
])
def test_rules_fire(spark, sf_dir, name, column):
    """The column that tells right from wrong has more than one value."""
    assert QUERIES[name](spark, sf_dir).select(column).distinct().count() >= 2
