"""Hand-made golden and edge rows (FIXTURES.md §3-§4) per operator."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from agendum.operators import history as H
from agendum.operators import membership as MB
from agendum.operators import metrics as M
from agendum.operators import relational as R
from agendum.operators import text as X
from agendum.operators import trends as T
from agendum.sources import events as EV
from agendum.streaming import operators as Z
from tests.conftest import rows_of

TS = "ts timestamp_ntz"


def t(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def test_ticket_metrics_readme_example(spark):
    # meeting 123, 10:00-10:01: 5 actionable, 8 status updates, 2 blockers (+ one NULL status row)
    base = t("2024-03-20T10:00:00")
    statuses = ["IN_PROGRESS"] * 3 + ["DONE"] * 2 + ["TODO"] * 3 + [None]
    contents = ["API BLOCKER found", "서버 차단 이슈"] + ["fine"] * 6 + [None]
    data = [(str(i), 123, base + dt.timedelta(seconds=5 * i), s, c)
            for i, (s, c) in enumerate(zip(statuses, contents))]
    df = spark.createDataFrame(data, f"ticket_id string, meeting_id long, {TS}, status string, content string")
    r = M.ticket_metrics(df, "1 minute").collect()
    assert len(r) == 1
    row = r[0]
    assert (row.window_start, row.window_end) == (base, t("2024-03-20T10:01:00"))
    assert (row.actionable_items_count, row.status_updates_count, row.blockers_mentioned) == (5, 8, 2)


def test_productivity_score_and_ratio(spark):
    base = t("2024-03-20T10:00:00")
    tickets = spark.createDataFrame(
        [(str(i), 7, base + dt.timedelta(seconds=i), "DONE" if i < 7 else "TODO") for i in range(10)],
        f"ticket_id string, meeting_id long, {TS}, status string")
    segs = spark.createDataFrame([(7, base + dt.timedelta(seconds=30))], f"meeting_id long, {TS}")
    r = M.productivity_score(segs, tickets, "1 minute").collect()[0]
    assert (r.ticket_count, r.actionable_tickets, r.segment_count) == (10, 7, 1)
    assert abs(r.productivity_score - 8.2) < 1e-9
    assert abs(r.productivity_ratio - 0.82) < 1e-9
    assert 0.4 <= r.productivity_ratio <= 1.0


def test_week_border_sunday_monday(spark):
    rt = spark.createDataFrame(
        [(1, t("2024-03-24T23:00:00"), t("2024-03-25T00:00:00"), 1.0),
         (1, t("2024-03-25T00:00:00"), t("2024-03-25T01:00:00"), 3.0)],
        "meeting_id long, window_start timestamp_ntz, window_end timestamp_ntz, productivity_score double")
    tm = rt.select("meeting_id", "window_start", "window_end", F.lit(1).alias("actionable_items_count"),
                   F.lit(2).alias("status_updates_count"))
    meetings = spark.createDataFrame([(1, 9)], "meeting_id long, group_id long")
    got = rows_of(T.group_trends(rt, tm, meetings, "week"), ["period_start", "avg_productivity"])
    assert got == [(t("2024-03-18T00:00:00"), 1.0), (t("2024-03-25T00:00:00"), 3.0)]


def test_chunk_flush_groups_rule(spark):
    sizes = [32768] * 5 + [100] + [32768] * 7
    df = spark.createDataFrame([(201, i + 1, n) for i, n in enumerate(sizes)],
                               "meeting_id long, seq long, n_bytes long")
    got = rows_of(H.chunk_flush_groups(df, 5, 32768, seq_bucket=4),
                  ["segment", "group_no", "first_seq", "last_seq", "n_chunks", "flush_reason"])
    assert got == [(0, 0, 1, 5, 5, "full"), (0, 1, 6, 6, 1, "short"),
                   (1, 0, 7, 11, 5, "full"), (1, 1, 12, 13, 2, "open")]


def test_decode_transcripts_rules(spark):
    msgs = spark.createDataFrame([
        ('{"meetingId": 131, "audioId": 315, "groupId": 1, "transcript": "hi", "isPartial": true}',),
        ('{"meetingId": 0, "audioId": 315, "groupId": 1, "transcript": "zero"}',),
        ('{"meetingId": 131, "groupId": 1, "transcript": "no audio"}',),
        ('{"meetingId": 131, "audioId": ',),
        ('{"meetingId": "131", "audioId": "316", "groupId": "1", "transcript": "as strings", "isPartial": true}',),
        ('{"meetingId": 131, "transcript": "", "isPartial": false}',),
        (None,),
    ], "value string")
    valid, rejects, markers = EV.decode_transcripts(msgs)
    assert rows_of(valid, ["meeting_id", "audio_id", "group_id", "text", "is_partial"]) == [
        (131, 315, 1, "hi", True), (131, 316, 1, "as strings", True)]
    assert rows_of(markers, ["meeting_id", "audio_id", "group_id", "is_partial"]) == [(131, None, None, False)]
    assert sorted(r.reject_reason for r in rejects.collect()) == ["malformed", "missing_id", "missing_id", "missing_id"]


def test_normalize_ticket_events_both_shapes(spark):
    msgs = spark.createDataFrame([
        ('{"meetingId": 131, "tickets": [{"ticketId": "a", "title": "Write document", "status": "TODO"},'
         ' {"ticketId": "b", "title": "Design UI", "status": "IN_PROGRESS", "assigneeId": 2}]}',),
        ('{"ticketId": "a", "status": "DONE", "assigneeId": 1, "assigneeName": "James", "reason": "done"}',),
    ], "value string")
    got = rows_of(EV.normalize_ticket_events(msgs), ["ticket_id", "meeting_id", "status", "assignee_id"])
    assert got == [("a", 131, "TODO", None), ("a", None, "DONE", 1), ("b", 131, "IN_PROGRESS", 2)]
    tickets = spark.createDataFrame([("a", 131)], "ticket_id string, meeting_id long")
    full = rows_of(EV.with_meeting(EV.normalize_ticket_events(msgs), tickets), ["ticket_id", "meeting_id", "status"])
    assert full == [("a", 131, "DONE"), ("a", 131, "TODO"), ("b", 131, "IN_PROGRESS")]


def test_patch_keeps_blank_and_clears_null_assignee(spark):
    base = spark.createDataFrame([("t1", "Write document", "body", "TODO", 5)],
                                 "ticket_id string, title string, content string, status string, assignee_id long")
    schema = "ticket_id string, title string, content string, status string, has_assignee_id boolean, assignee_id long, at int"
    p = spark.createDataFrame([("t1", "", None, "", True, None, 1), ("zz", "x", None, "DONE", False, None, 1)], schema)
    r = R.patch(base, p, ["at"]).collect()
    assert len(r) == 1
    assert (r[0].title, r[0].content, r[0].status, r[0].assignee_id, r[0].status_updates) == \
        ("Write document", "body", "TODO", None, 0)
    # Earlier patches stay: a later one without a title keeps the title set before.
    p = spark.createDataFrame([("t1", "", None, "DONE", False, 9, 3), ("t1", "New", None, "IN_PROGRESS", True, 7, 1),
                               ("t1", "", "text", None, False, None, 2)], schema)
    r = R.patch(base, p, ["at"]).first()
    assert (r.title, r.content, r.status, r.assignee_id, r.status_updates) == ("New", "text", "DONE", 7, 2)
    assert rows_of(R.patch_events(base.withColumn("meeting_id", F.lit(5)), p), ["ticket_id", "meeting_id", "status"]) == [
        ("t1", 5, "DONE"), ("t1", 5, "IN_PROGRESS")]


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("1", "TODO", 1), ("2", "TODO", 2)], "ticket_id string, status string, v long")
    ch = spark.createDataFrame([("2", "DONE"), ("3", "IN_PROGRESS")], "ticket_id string, status string")
    once = R.upsert(base, ch, ["ticket_id"], ["status"])
    twice = R.upsert(once, ch, ["ticket_id"], ["status"])
    assert rows_of(once) == rows_of(twice) == [("1", "TODO", 1), ("2", "DONE", 2), ("3", "IN_PROGRESS", None)]


def test_stitch_order_independent_and_drops_repeats(spark):
    segs = [(131, 4, "b"), (131, 2, ""), (131, 1, "a"), (131, 3, "a"), (131, 5, None), (131, 6, "a")]
    df = spark.createDataFrame(segs, "meeting_id long, seq long, text string")
    out = X.stitch_transcripts(df, chunk=2).orderBy("piece").collect()
    assert "\n".join(r.transcript for r in out) == "a\nb\na"
    shuffled = spark.createDataFrame(list(reversed(segs)), "meeting_id long, seq long, text string")
    assert rows_of(X.stitch_transcripts(shuffled, chunk=2)) == rows_of(X.stitch_transcripts(df, chunk=2))


def test_detect_assignee_golden_meeting(spark):
    segs = spark.createDataFrame([
        (131, 1, "James will write the document tomorrow. And Julia is designing the UI right now."),
        (131, 2, "James will write the document tomorrow."),
        (131, 3, "Julia likes coffee."),
        (131, 4, "Ask James, he will do it."),
        (131, 5, "James is willing to listen."),
        (131, 6, "James is working on this."),
    ], "meeting_id long, seq long, text string")
    members = spark.createDataFrame([(1, 1, "ADMIN"), (1, 2, "MEMBER")], "group_id long, user_id long, role string")
    users = spark.createDataFrame([(1, "James"), (2, "Julia")], "user_id long, name string")
    meetings = spark.createDataFrame([(131, 1, 315), (131, 1, 316)], "meeting_id long, group_id long, audio_id long")
    got = rows_of(X.detect_assignee(segs, members, users, meetings), ["seq", "assignee_id"])
    assert got == [(1, None), (2, 1), (3, None), (4, 1), (5, None), (6, 1)]


def test_status_intent_korean_and_english(spark):
    df = spark.createDataFrame([
        (1, "백엔드 API 문서화 작업을 현재 진행하고 있습니다."),
        (2, "프론트엔드 로그인 페이지 구현이 완료되었습니다."),
        (3, "Backend API documentation work is currently in progress."),
        (4, "It was in progress and is now completed."),
        (5, "Nothing to report."),
    ], "seq long, text string")
    got = rows_of(X.status_intent(df), ["seq", "intent"])
    assert got == [(1, "IN_PROGRESS"), (2, "DONE"), (3, "IN_PROGRESS"), (4, "DONE"), (5, None)]


def test_transition_check(spark):
    h = spark.createDataFrame([("t", "TODO", "DONE"), ("t", "DONE", "TODO"), ("t", None, "TODO"),
                               ("t", "IN_PROGRESS", "DONE")], "ticket_id string, old_status string, new_status string")
    assert rows_of(H.check_transitions(h), ["old_status", "new_status"]) == [("DONE", "TODO")]


def test_await_transcripts_first_match_and_timeout(spark):
    r = spark.createDataFrame([(1, 201, t("2024-01-01T00:00:00")), (2, 202, t("2024-01-01T00:00:00"))],
                              f"request_id long, meeting_id long, {TS}")
    tr = spark.createDataFrame([(201, t("2024-01-01T00:00:20")), (201, t("2024-01-01T00:00:10")),
                                (201, t("2024-01-01T00:00:45")), (202, t("2024-01-01T00:00:31"))],
                               f"meeting_id long, {TS}")
    got = rows_of(Z.await_transcripts(r, tr, "30 seconds", 30), ["request_id", "first_transcript_at", "timed_out"])
    assert got == [(1, t("2024-01-01T00:00:10"), False), (2, None, True)]


def test_membership_rules(spark):
    members = spark.createDataFrame([(1, 10, "ADMIN"), (1, 11, "MEMBER"), (2, 20, "ADMIN")],
                                    "group_id long, user_id long, role string")
    users = spark.createDataFrame([(10, "a", "a@x"), (11, "b", "b@x"), (12, "c", "c@x"), (20, "d", "d@x")],
                                  "user_id long, name string, email string")
    changes = spark.createDataFrame([
        (1, 10, 1, "invite", "c@x", "MEMBER"),     # admin invites c -> inserted
        (2, 11, 1, "remove", "a@x", "MEMBER"),     # not an admin -> rejected
        (3, 10, 1, "invite", "nobody@x", "MEMBER"),  # unknown e-mail -> rejected
        (4, 10, 1, "role", "b@x", "OWNER"),        # bad role -> rejected
        (5, 10, 1, "role", "b@x", "ADMIN"),        # promote b
        (6, 20, 2, "create", "d@x", "MEMBER"),     # d creates a group and becomes its admin
    ], "change_id long, requester_id long, group_id long, action string, email string, new_role string")
    snap = rows_of(MB.apply_membership(members, users, changes), ["group_id", "user_id", "role"])
    assert snap == [(-7, 20, "ADMIN"), (1, 10, "ADMIN"), (1, 11, "ADMIN"), (1, 12, "MEMBER"), (2, 20, "ADMIN")]
    rej = rows_of(MB.membership_rejects(members, users, changes), ["change_id", "reject_reason"])
    assert rej == [(2, "not_admin"), (3, "unknown_email"), (4, "bad_role")]


def test_latest_and_first_row(spark):
    df = spark.createDataFrame([(131, 315, 1, "a"), (131, 315, 2, "b"), (131, 316, 1, "c")],
                               "meeting_id long, audio_id long, seq long, text string")
    latest = R.latest_by_key(df, ["audio_id"], ["seq"])
    assert rows_of(latest, ["audio_id", "text"]) == [(315, "b"), (316, "c")]
    assert rows_of(R.first_row(latest, ["meeting_id"], "audio_id"), ["meeting_id", "audio_id", "text"]) == \
        [(131, 315, "b")]


def test_validate_rows(spark):
    df = spark.createDataFrame([(" ", "a@x", "ADMIN"), ("n", "ax", "MEMBER"), ("n", "a@x", "OWNER"),
                                ("n", "a@x", "MEMBER")], "name string, email string, role string")
    got = [r.reject_reason for r in R.validate_rows(df).collect()]
    assert got == ["blank_name", "bad_email", "bad_role", None]
