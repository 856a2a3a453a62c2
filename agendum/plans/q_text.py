"""Queries over transcript text."""

from __future__ import annotations

from pyspark.sql import functions as F

from agendum.functions.expressions import WHITESPACE_PATTERN
from agendum.operators import text as X
from agendum.plans.common import rounded
from agendum.plans.registry import query
from agendum.plans.sqlviews import (GROUP_MEMBERS, MEETINGS, ORDERED_TRANSCRIPTS, SPOKEN_TRANSCRIPTS, TICKETS,
                                    TIMED_TRANSCRIPTS, USERS, with_views)
from agendum.sources import testdata as td

TOP_K = 5
MATCH_THRESHOLD = 0.5


def _tok(col: str) -> str:
    """DuckDB twin of ``functions.expressions.tokens``."""
    return f"list_filter(string_split_regex(lower({col}), '{WHITESPACE_PATTERN}'), lambda x: x <> '')"


def _name_tok(col: str) -> str:
    """DuckDB twin of ``text.name_tokens``."""
    return f"list_filter(list_transform({_tok(col)}, lambda y: regexp_replace(y, '{X.NAME_EDGES}', '', 'g')), lambda z: z <> '')"


@query("stitch_transcripts", sql=with_views(f"""
, s AS (SELECT * FROM ot WHERE text IS NOT NULL AND text <> '')
, l AS (SELECT *, lag(text) OVER (PARTITION BY meeting_id ORDER BY seq) AS prev FROM s)
SELECT meeting_id, seq // {X.STITCH_CHUNK} AS piece, min(seq) AS first_seq, max(seq) AS last_seq,
       count(*) AS n_segments, string_agg(text, chr(10) ORDER BY seq) AS transcript
FROM l WHERE prev IS DISTINCT FROM text GROUP BY ALL""", ot=ORDERED_TRANSCRIPTS))
def q_stitch_transcripts(spark, d):
    return X.stitch_transcripts(td.ordered_transcripts(spark, d))


_TF_SQL = f"""
, toks AS (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents)
, tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL)
"""


@query("token_counts", sql=with_views(_TF_SQL + "SELECT * FROM tf", n="SELECT 1"))
def q_token_counts(spark, d):
    return X.term_frequencies(td.transcript_documents(spark, d))


_TFIDF_SQL = _TF_SQL + """
, dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
, w AS (SELECT doc_id, term, tf, df, round(tf * ln((n.n + 1.0) / (df + 1.0)), 6) AS tfidf
        FROM tf JOIN dfq USING (term), (SELECT count(*) AS n FROM documents) n)
"""


def tfidf_df(spark, d):
    return rounded(X.tfidf(td.transcript_documents(spark, d)).select("doc_id", "term", "tf", "df", "tfidf"))


@query("tfidf_keywords", sql=with_views(_TFIDF_SQL + "SELECT * FROM w", n="SELECT 1"))
def q_tfidf_keywords(spark, d):
    return tfidf_df(spark, d)


@query("top_keywords", sql=with_views(_TFIDF_SQL + f"""
SELECT doc_id, term, tfidf, CAST(rank AS INTEGER) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS rank FROM w)
WHERE rank <= {TOP_K}""", n="SELECT 1"))
def q_top_keywords(spark, d):
    return X.top_terms(tfidf_df(spark, d), TOP_K).select("doc_id", "term", "tfidf", "rank")


@query("keyword_trend", sql=with_views(f"""
, c AS (SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, term, count(*) AS n
        FROM (SELECT ts, unnest({_tok('text')}) AS term FROM tt) GROUP BY ALL)
SELECT window_start, term, n, lag(n) OVER w AS prev_n, n - lag(n) OVER w AS delta
FROM c WINDOW w AS (PARTITION BY term ORDER BY window_start)""", tt=TIMED_TRANSCRIPTS))
def q_keyword_trend(spark, d):
    return X.keyword_trend(td.timed_transcripts(spark, d), "1 day")


@query("duplicate_tickets", sql=with_views("""
SELECT meeting_id, lower(trim(title)) AS norm_title, count(*) AS dup_count, min(created_at) AS first_created_at
FROM t GROUP BY ALL HAVING count(*) > 1""", t=TICKETS))
def q_duplicate_tickets(spark, d):
    return X.duplicate_tickets(td.tickets(spark, d))


@query("match_titles", sql=f"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                      generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
, ml AS (SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, list_distinct({_tok('line')}) AS ms FROM lines)
, bt AS (SELECT item_id AS ticket_id, list_distinct({_tok('text')}) AS ts FROM benchmark)
, p AS (SELECT doc_id, line_no, ticket_id,
               len(list_intersect(ms, ts)) / len(list_distinct(list_concat(ms, ts))) AS j
        FROM ml, bt WHERE len(ms) > 0 AND len(ts) > 0)
SELECT doc_id, line_no, ticket_id, round(j, 6) AS jaccard FROM p WHERE j >= {MATCH_THRESHOLD}""")
def q_match_titles(spark, d):
    lines = X.document_lines(td.transcript_documents(spark, d)).select(
        F.struct("doc_id", F.col("line_no").cast("long").alias("line_no")).alias("mention_id"), F.col("line").alias("text"))
    items = td.table(spark, d, "benchmark").select(F.col("item_id").alias("ticket_id"), F.col("text").alias("title"))
    return rounded(X.match_titles(lines, items, MATCH_THRESHOLD).select("mention_id.*", "ticket_id", "jaccard"))


def _intent_sql() -> str:
    whens = " ".join(f"WHEN regexp_matches(text, '{X.intent_pattern(p)}') THEN '{s}'"
                     for s, p in X.STATUS_INTENT_LEXICON)
    return f"CASE {whens} END"


@query("status_intent", sql=with_views(
    f"SELECT meeting_id, seq, {_intent_sql()} AS intent FROM ot", ot=SPOKEN_TRANSCRIPTS))
def q_status_intent(spark, d):
    return X.status_intent(td.spoken_transcripts(spark, d)).select("meeting_id", "seq", "intent")


@query("detect_assignee", sql=with_views(f"""
, seg AS (SELECT ot.meeting_id, seq, text, group_id FROM ot LEFT JOIN m ON m.meeting_id = ot.meeting_id)
, nm AS (SELECT gm.group_id, gm.user_id, lower(u.name) AS lname, ({_name_tok('u.name')})[1] AS tok
         FROM gm JOIN u ON u.user_id = gm.user_id)
, hits AS (SELECT seg.meeting_id, seg.seq, count(DISTINCT nm.user_id) AS n_named, min(nm.user_id) AS named_user
           FROM seg JOIN nm ON nm.group_id = seg.group_id
           WHERE nm.tok IS NOT NULL AND list_contains({_name_tok('seg.text')}, nm.tok)
             AND instr(lower(seg.text), nm.lname) > 0
           GROUP BY ALL)
SELECT seg.meeting_id, seg.seq,
       CASE WHEN n_named = 1 AND regexp_matches(seg.text, '{X.intent_pattern(X.OWNERSHIP_PHRASES).replace("'", "''")}')
            THEN named_user END AS assignee_id
FROM seg LEFT JOIN hits ON hits.meeting_id = seg.meeting_id AND hits.seq = seg.seq""",
    ot=SPOKEN_TRANSCRIPTS, m=MEETINGS, gm=GROUP_MEMBERS, u=USERS))
def q_detect_assignee(spark, d):
    return X.detect_assignee(td.spoken_transcripts(spark, d), td.group_members(spark, d),
                             td.users(spark, d), td.meetings(spark, d))


@query("suggest_assignee", sql=with_views(f"""
, t2 AS (SELECT group_id, assignee_id, unnest(list_distinct({_tok('title')})) AS term
         FROM t JOIN m USING (meeting_id) WHERE assignee_id IS NOT NULL)
, c AS (SELECT group_id, term, assignee_id, count(*) AS n FROM t2 GROUP BY ALL)
SELECT group_id, term, assignee_id, n FROM
  (SELECT *, row_number() OVER (PARTITION BY group_id, term ORDER BY n DESC, assignee_id) AS rn FROM c)
WHERE rn = 1""", t=TICKETS, m=MEETINGS))
def q_suggest_assignee(spark, d):
    return X.suggest_assignee(td.tickets(spark, d), td.meetings(spark, d))
