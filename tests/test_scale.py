"""What one task holds follows the input's rows, not the number of tasks, and no
key without a value gathers rows."""

from __future__ import annotations

import math

from agendum.operators import analysis as A
from agendum.operators import quality as Q
from agendum.operators import text as X
from tests.conftest import rows_of


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_unique_keys_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(Q, "ROWS_PER_TASK", 10)
    df = spark.range(100).selectExpr("id % 97 AS k", "if(id < 3, NULL, id) AS v")
    out = Q.check_unique({"k": (df, ["k"]), "v": (df, ["v"]), "empty": (df.limit(0), ["k"])})
    assert physical(out).count("hashpartitioning(k#") >= 1 and ", 10), REPARTITION_BY_NUM" in physical(out)
    assert rows_of(out) == [("k", "0", 2), ("k", "1", 2), ("k", "2", 2), ("v", "", 3)]


def test_context_keeps_tickets_without_an_assignee_out_of_the_join(spark):
    seg = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "meeting_id long, seq long, text string")
    tk = spark.createDataFrame([("x", 1, "t", "TODO", None), ("y", 1, "u", "DONE", 7), ("z", 9, "v", "TODO", None), ("n", None, "w", "TODO", 7)],
                               "ticket_id string, meeting_id long, title string, status string, assignee_id long")
    members = spark.createDataFrame([(5, 7)], "group_id long, user_id long")
    users = spark.createDataFrame([(7, "Kim"), (None, "Nobody")], "user_id long, name string")
    meetings = spark.createDataFrame([(1, 5), (1, 5), (3, 6), (None, 5)], "meeting_id long, group_id long")
    out = A.analysis_context(seg, tk, members, users, meetings)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter, (assignee_id#" in line]
    assert len(joins) == 1 and "isnotnull(assignee_id#" in plan and "isnull(assignee_id#" in plan
    assert [r[4] for r in rows_of(out.filter("section = '3_tickets'"))] == [
        "- [TODO] t (ID: x, Assignee: Unassigned)", "- [DONE] u (ID: y, Assignee: Kim)", A.NO_TICKETS_LINE]
    assert [r[:4] for r in rows_of(out.filter("section like '2%'"))] == [("group", 5, "2_members", "7"), ("meeting", 1, "2_group", "5")]


def test_terms_are_counted_where_their_document_lies(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b  A\n"), (1, "b c"), (2, " "), (3, None), (None, "x"), (None, "x y"), (4, "")], "doc_id long, text string")
    expected = [(1, "a", 2), (1, "b", 2), (1, "c", 1), (None, "x", 2), (None, "y", 1)]
    tf = X.term_frequencies(docs)
    assert rows_of(tf) == expected
    assert "hashpartitioning(doc_id#" in physical(tf) and ", term#" not in physical(tf).split("Exchange", 1)[1]
    monkeypatch.setattr(X, "HOT_BYTES", 3)      # the ids with several rows are dealt by term
    hot = X.term_frequencies(docs)
    assert rows_of(hot) == expected and physical(hot).count("BroadcastHashJoin") == 2


def test_weights_share_one_shuffle_of_the_counts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (None, "b c"), (3, None)], "doc_id long, text string")
    w = X.tfidf(docs)
    got = {(r.doc_id, r.term): (r.tf, r.df, round(r.tfidf, 9)) for r in w.collect()}
    of = lambda tf, df: (tf, df, round(tf * math.log(5 / (df + 1)), 9))
    assert got == {(1, "a"): of(2, 1), (1, "b"): of(1, 3), (2, "b"): of(1, 3), (None, "b"): of(1, 3), (None, "c"): of(1, 1)}
    w.collect()
    assert "ReusedExchange" in physical(w)
