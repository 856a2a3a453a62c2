"""Transcript text operators.

Text is processed whole. Anything gathered per meeting is gathered in
bounded pieces (sequence ranges), and similarity joins are equi-joins on
tokens with an exact prefix filter, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agendum.functions.expressions import WHITESPACE_PATTERN, tokens
from agendum.functions.windows import segmented_shift
from agendum.operators.relational import meeting_groups

# --- fixed values -----------------------------------------------------------
# Status-change intent phrases, English and Korean, in priority order:
# a segment that has both is read as the later state.
STATUS_INTENT_LEXICON = (
    ("DONE", ("completed", "finished", "완료")),
    ("IN_PROGRESS", ("in progress", "working on", "진행")),
)
# Ownership phrases that make a named member the assignee.
OWNERSHIP_PHRASES = ("will", "i'll", "is going to", "is designing", "is working on", "담당", "맡")
# ---------------------------------------------------------------------------

NAME_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
STITCH_CHUNK = 1000     # segments per stitched piece (by sequence number)
TASK_BYTES = 4 << 20    # of the documents whose terms one task counts
HOT_BYTES = 64 << 20    # of the rows of one document id that one task may count


def stitch_transcripts(segments: DataFrame, key: str = "meeting_id", seq: str = "seq",
                       text: str = "text", chunk: int = STITCH_CHUNK,
                       drop_repeats: bool = True) -> DataFrame:
    """The meeting transcript in sequence order, empty segments dropped and
    a segment equal to the previous kept one dropped, joined with newlines.

    The text of a meeting is produced in pieces of ``chunk`` sequence numbers
    (``piece``), in order; a meeting's full transcript is its pieces in
    ``piece`` order. This keeps every row bounded however long a meeting is.
    """
    s = segments.filter(F.col(text).isNotNull() & (F.col(text) != ""))
    piece = F.floor(F.col(seq) / F.lit(chunk))
    if drop_repeats:
        s = segmented_shift(s, [key], [seq], [text], piece, "lag", prefix="__prev_")
        s = s.filter(~F.col(f"__prev_{text}").eqNullSafe(F.col(text))).drop(f"__prev_{text}")
    g = s.groupBy(key, piece.alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t")))).alias("__parts"),
        F.count(F.lit(1)).alias("n_segments"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"))
    return g.select(key, "piece", "first_seq", "last_seq", "n_segments",
                    F.array_join(F.transform("__parts", lambda p: p["t"]), "\n").alias("transcript"))


def tokenize(df: DataFrame, text: str = "text", out: str = "term") -> DataFrame:
    """One row per token (lower case, split on whitespace, blanks gone)."""
    rest = [c for c in df.columns if c != text]
    parts = F.split(F.lower(F.col(text)), WHITESPACE_PATTERN)      # as ``tokens``; blanks go row by row, in compiled code
    return df.select(*rest, F.explode(parts).alias(out)).filter(F.col(out) != "")


def term_frequencies(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, term, tf) in long form.

    Texts are dealt by document over as many tasks as their bytes ask for, and a
    task counts the terms of its documents: the texts are shuffled once and their
    tokens never. Rows of an id with more than ``HOT_BYTES`` are dealt by term."""
    d = docs.select(doc, text)
    sizes = d.groupBy(doc).agg(F.sum(F.octet_length(text).cast("long")).alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    hot = (F.col("__rows") > 1) & (F.col("__bytes") > HOT_BYTES)
    n_bytes, n_hot = sizes.agg(F.coalesce(F.sum("__bytes"), F.lit(0)), F.count_if(hot)).first()

    def counted(x: DataFrame) -> DataFrame:
        return tokenize(x, text).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))

    def dealt(x: DataFrame) -> DataFrame:
        return x.repartition(max(d.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES)), doc)

    if not n_hot:
        return counted(dealt(d))
    ids = F.broadcast(sizes.filter(hot).select(F.col(doc).alias("__hot")))      # one for every HOT_BYTES at most
    is_hot = F.col(doc).eqNullSafe(F.col("__hot"))
    return counted(dealt(d.join(ids, is_hot, "left_anti"))).unionByName(counted(d.join(ids, is_hot, "left_semi")))


def tfidf(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """T4: tf * ln((N + 1) / (df + 1)), Spark ML's IDF formula, on exact
    terms. N is a scalar subquery. The counts are shuffled by term once; the
    per-term document frequency is taken and joined back where they lie."""
    tf = term_frequencies(docs, doc, text).repartition("term")
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    # df = documents in which the term occurs (tf > 0); all columns are read here, so
    # that the plan reuses the shuffle by term instead of counting the terms twice.
    dfreq = tf.groupBy("term").agg(F.count_if((F.col("tf") > 0) | F.col(doc).isNull()).alias("df"))
    return (tf.join(dfreq, "term")
              .withColumn("idf", F.ln((n_docs + F.lit(1)).cast("double") / (F.col("df") + 1).cast("double")))
              .withColumn("tfidf", F.col("tf").cast("double") * F.col("idf")))


def top_terms(weights: DataFrame, k: int, key: str = "doc_id", weight: str = "tfidf") -> DataFrame:
    """The k heaviest terms per key (term breaks ties)."""
    w = Window.partitionBy(key).orderBy(F.col(weight).desc(), F.col("term"))
    return weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def keyword_trend(segments: DataFrame, window_duration: str = "1 day", ts: str = "ts",
                  text: str = "text") -> DataFrame:
    """T5: term counts per time window and the change from the term's previous
    window (one row per term and window, so per-term ordering is small)."""
    counts = (tokenize(segments.select(ts, text), text)
              .groupBy(F.window(ts, window_duration).start.alias("window_start"), "term")
              .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("term").orderBy("window_start")
    return (counts.withColumn("prev_n", F.lag("n").over(w))
                  .withColumn("delta", F.col("n") - F.col("prev_n")))


def duplicate_tickets(tickets: DataFrame) -> DataFrame:
    """Tickets of one meeting whose trimmed, lower-cased titles coincide."""
    norm = F.lower(F.trim(F.col("title")))
    return (tickets.groupBy("meeting_id", norm.alias("norm_title"))
            .agg(F.count(F.lit(1)).alias("dup_count"), F.min("created_at").alias("first_created_at"))
            .filter(F.col("dup_count") > 1))


def _token_sets(df: DataFrame, id_col: str, text: str, block: Sequence[str]) -> DataFrame:
    return df.select(*block, F.col(id_col).alias("__id"), F.array_distinct(tokens(text)).alias("__set")) \
             .filter(F.size("__set") > 0)


def match_titles(mentions: DataFrame, tickets: DataFrame, threshold: float = 0.5,
                 mention_id: str = "mention_id", mention_text: str = "text",
                 ticket_id: str = "ticket_id", title: str = "title",
                 block: Sequence[str] = ()) -> DataFrame:
    """Every (mention, ticket) pair, within the same ``block`` keys, whose
    token sets have Jaccard similarity >= ``threshold``. Exact.

    Prefix filtering: with any fixed global order of tokens, two sets with
    Jaccard >= t share a token among the first ``|x| - ceil(t * |x|) + 1``
    tokens of each. The order used is (frequency among ticket titles, token):
    tokens no ticket has come first and can never pair, and common title words
    come last, so few candidates are produced. Candidates come from an
    equi-join on prefix tokens and pass a length and a positional filter (the
    pair's first common token always does), then the exact similarity is verified.
    """
    m = _token_sets(mentions, mention_id, mention_text, block)
    t = _token_sets(tickets, ticket_id, title, block)
    freq = (t.select(F.explode("__set").alias("tok")).groupBy("tok")
            .agg(F.count(F.lit(1)).alias("f")))

    def prefixes(s: DataFrame, tag: str) -> DataFrame:
        e = (s.select(*block, "__id", F.explode("__set").alias("tok"), F.size("__set").alias("__n"))
             .join(freq, "tok"))                     # tokens no ticket has can't pair; they come first in the order
        of_set = Window.partitionBy(*block, "__id")
        unseen = F.col("__n") - F.count(F.lit(1)).over(of_set)
        # the epsilon keeps n * t from rounding up past an integer
        plen = F.col("__n") - F.ceil(F.col("__n") * F.lit(threshold) - F.lit(1e-9)) + 1
        return (e.withColumn("__pos", unseen + F.row_number().over(of_set.orderBy("f", "tok")))
                 .filter(F.col("__pos") <= plen)
                 .select(*block, F.col("__id").alias(f"__{tag}id"), "tok", F.col("__n").alias(f"__{tag}n"), F.col("__pos").alias(f"__{tag}pos")))

    nm, nt = F.col("__mn"), F.col("__tn")
    need = F.ceil((nm + nt) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    cand = (prefixes(m, "m").join(prefixes(t, "t"), [*block, "tok"])
            .filter(F.least(nm, nt) >= F.greatest(nm, nt) * F.lit(threshold) - F.lit(1e-9))          # sizes allow it
            .filter(F.least(nm - F.col("__mpos"), nt - F.col("__tpos")) + 1 >= need)                  # so do the places
            .select(*block, "__mid", "__tid").distinct())
    ms = m.select(*block, F.col("__id").alias("__mid"), F.col("__set").alias("__ms"))
    ts_ = t.select(*block, F.col("__id").alias("__tid"), F.col("__set").alias("__ts"))
    j = cand.join(ms, [*block, "__mid"]).join(ts_, [*block, "__tid"])
    inter = F.size(F.array_intersect("__ms", "__ts"))
    union = F.size(F.array_union("__ms", "__ts"))
    return (j.withColumn("jaccard", inter.cast("double") / union.cast("double"))
             .filter(F.col("jaccard") >= F.lit(threshold))
             .select(*block, F.col("__mid").alias(mention_id), F.col("__tid").alias(ticket_id), "jaccard"))


def intent_pattern(phrases: Sequence[str]) -> str:
    """Any of the phrases; Latin ones stand alone (``willing`` is not ``will``)."""
    return "(?i)(" + "|".join(rf"\b{p}\b" if p.isascii() else p for p in phrases) + ")"


def name_tokens(col: str | Column) -> Column:
    """Tokens without the punctuation around them, as names appear in speech."""
    bare = F.transform(tokens(col), lambda t: F.regexp_replace(t, NAME_EDGES, ""))
    return F.filter(bare, lambda t: t != "")


def status_intent(segments: DataFrame, text: str = "text",
                  lexicon=STATUS_INTENT_LEXICON) -> DataFrame:
    """The status a segment announces (first lexicon entry that matches),
    NULL when none does."""
    expr = None
    for status, phrases in lexicon:
        cond = F.col(text).rlike(intent_pattern(phrases))
        expr = F.when(cond, F.lit(status)) if expr is None else expr.when(cond, F.lit(status))
    return segments.withColumn("intent", expr.otherwise(F.lit(None).cast("string")))


def detect_assignee(segments: DataFrame, members: DataFrame, users: DataFrame,
                    meetings: DataFrame, seg_id: Sequence[str] = ("meeting_id", "seq"),
                    text: str = "text") -> DataFrame:
    """The group member named in a segment that also has an ownership
    phrase; NULL when no member or more than one member is named.

    Names are matched on their first token with an equi-join on
    (group, token), then the full name is verified in the text, so only
    segments that mention a name meet that member."""
    seg = segments.join(meeting_groups(meetings), "meeting_id", "left")
    owns = F.col(text).rlike(intent_pattern(OWNERSHIP_PHRASES))
    seg_tokens = (seg.select(*seg_id, "group_id", F.explode(F.array_distinct(name_tokens(text))).alias("tok")))
    names = (members.join(users.select("user_id", "name"), "user_id")
             .select("group_id", "user_id", F.lower(F.col("name")).alias("lname"))
             .withColumn("tok", F.get(name_tokens("lname"), 0))
             .filter(F.col("tok").isNotNull()))
    hits = (seg_tokens.join(names, ["group_id", "tok"])
            .join(seg.select(*seg_id, text), list(seg_id))
            .filter(F.instr(F.lower(F.col(text)), F.col("lname")) > 0)
            .groupBy(*seg_id).agg(F.count_distinct("user_id").alias("n_named"),
                                  F.min("user_id").alias("named_user")))
    out = seg.join(hits, list(seg_id), "left")
    return out.select(*seg_id, F.when((F.col("n_named") == 1) & owns, F.col("named_user"))
                      .cast("long").alias("assignee_id"))


def suggest_assignee(tickets: DataFrame, meetings: DataFrame) -> DataFrame:
    """Per group and title term, the assignee who most often holds
    tickets with that term (smallest id breaks ties)."""
    t = (tickets.filter(F.col("assignee_id").isNotNull())
         .join(meeting_groups(meetings), "meeting_id")
         .select("group_id", "assignee_id", F.explode(F.array_distinct(tokens("title"))).alias("term")))
    counts = t.groupBy("group_id", "term", "assignee_id").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("group_id", "term").agg(
        F.max_by(F.struct("assignee_id", "n"), F.struct(F.col("n"), -F.col("assignee_id"))).alias("b"))
    return best.select("group_id", "term", "b.assignee_id", "b.n")


def document_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Split documents into (doc, line_no, line) rows, line numbers from 1."""
    return docs.select(doc, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")) \
               .select(doc, (F.col("pos") + 1).alias("line_no"), "line")
