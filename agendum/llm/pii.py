"""Personal data: base patterns, and bootstrapped contextual extraction.

Base spans come from regular expressions; a match's place is the summed length of
the pieces and matches before it (``split`` and ``regexp_extract_all`` by one
pattern), counted in code points.

Bootstrapping: words with a digit are instances, without the marks around them.
Seeds are instances that overlap a base span, and those of a secret's shape
(``SECRET``). An instance that overlaps a failed base match (a card number that
fails Luhn, say) and no base span is a counter-example. Every instance has lexical
patterns: the word before it, the two words before it, the word after it (digits
read as 0, neighbouring instances included). Patterns and instances are a graph,
scored by turns: a pattern's confidence is the summed score of its distinct
instances over their number plus one, if at least ``MIN_SEEDS`` of them are surely
identifiers; an instance's score is the confidence of its best pattern, but 1 for
seeds and 0 for counter-examples throughout. After ``ROUNDS`` rounds the instances
outside base spans that have a pattern of confidence ``ACCEPT`` or more and look like
identifiers (``MIN_LENGTH`` characters, no counter-example) are new spans, of kind
``context``; the shape of a secret alone makes no span.

All of it is built-in column functions. The one pass over the texts writes what
it found, without the texts, to the shared folder; all later steps start there.

Edge cases: a null or empty text has no spans; repeated rows are scanned as often
as they occur (and count once as instances); very long texts take time in proportion
to their length, and all spans of one text are in one task; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agendum.llm.storage import cut

KINDS = ["email", "ip", "card", "phone"]
FOUND = "context"
ROUNDS, MIN_SEEDS, ACCEPT, MIN_LENGTH = 3, 3, 0.7, 6

# The base patterns, with possessive quantifiers where backing up could not help
# and a check of the character before, so that long runs take linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must have for a pattern to be tried at all.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
INSTANCE = r"(?<![^\s])(?=[^\s0-9]*+[0-9])[^\s]++"
# Twenty characters or more in which letters and digits take turns at least four times.
SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{20})(?:[A-Za-z_-]*+[0-9]++){4}"
MARKS = r"[^\p{L}\p{N}]"


def _luhn(digits: F.Column) -> F.Column:
    n = F.length(digits)

    def worth(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: F.Column, match: F.Column) -> F.Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    # A part of up to 255 has at most three digits after its leading zeros.
    parts = F.forall(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3)
    small = F.forall(F.split(match, r"\."), lambda p: F.substring(p, -3, 3).cast("int") <= 255)
    n = F.length(digits)
    return (F.when(kind == "ip", F.when(parts, small).otherwise(False))
            .when(kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", n.between(9, 15)).otherwise(True))


def _found(text: F.Column, pattern: str, hint: str, context: bool = False) -> F.Column:
    """Matches of a text in order: the match, the length of the piece before it,
    and for ``context`` the last two words of that piece and the first of the next."""
    pieces = F.split(text, pattern, -1)
    fields = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.transform(pieces, lambda p: F.length(p)).alias("gap")]
    if context:
        words = F.transform(pieces, lambda p: F.filter(F.split(p, r"\s+"), lambda w: w != ""))
        fields += [F.transform(words, lambda w: F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2))).alias("before"),
                   F.transform(F.slice(words, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda w: F.get(w, F.lit(0))).alias("after")]
    zipped = F.arrays_zip(*fields)
    return F.when(text.rlike(hint), F.filter(zipped, lambda x: x["match"].isNotNull()))


def matches(docs: DataFrame) -> DataFrame:
    """One row per text: row_id, doc_id, the matches of each base pattern, the instances."""
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    return cut(rows.select("row_id", "doc_id", *[_found(text, PATTERNS[k], HINTS[k]).alias(k) for k in KINDS],
                           _found(text, INSTANCE, "[0-9]", context=True).alias("instance")), "pii-matches")


def _placed(rows: DataFrame, column: str, extra: list[F.Column] = []) -> DataFrame:
    """row_id, match, start, end (code points) of a column of ``matches``."""
    each = rows.select("row_id", F.posexplode(column).alias("nth", "m")).select("row_id", "nth", "m.*")
    w = W.partitionBy("row_id").orderBy("nth")    # a window holds the matches of one text
    end = F.sum(F.col("gap") + F.length("match")).over(w)
    return each.select("row_id", "match", end.alias("end"), *extra).withColumn("start", F.col("end") - F.length("match"))


def base_matches(rows: DataFrame) -> DataFrame:
    """row_id, kind (number), start, end, holds of the base matches that hold, and of
    those that look like their kind but fail (a number too short for a card does not)."""
    out = None
    for number, kind in enumerate(KINDS):
        part = _placed(rows, kind).withColumn("holds", _valid(F.lit(kind), F.col("match")))
        if kind == "card":
            part = part.where(F.length(F.regexp_replace("match", "[^0-9]", "")) >= 13)
        part = part.select("row_id", F.lit(number).alias("kind"), "start", "end", "holds")
        out = part if out is None else out.union(part)
    return out


def _instances(rows: DataFrame, found: DataFrame) -> DataFrame:
    """row_id, match, start, end, known (overlaps a base span), failed (overlaps only
    failed ones), patterns. Matches and instances of a text are merged in order of place."""
    w = W.partitionBy("row_id").orderBy("nth")
    none = F.array().cast("array<string>")
    sooner = F.concat(F.coalesce(F.array(F.lag("match", 2).over(w)), none), F.coalesce(F.lag("before", 1).over(w), none),
                      F.coalesce(F.array(F.lag("match", 1).over(w)), none), F.coalesce("before", none))
    near = [F.filter(sooner, lambda x: x.isNotNull()).alias("sooner"), F.coalesce("after", F.lead("match", 1).over(w)).alias("later")]
    plain = lambda c: F.lower(F.regexp_replace(c, "[0-9]", "0"))
    n = F.size("sooner")
    patterns = F.array(F.concat(F.lit("<1 "), plain(F.get("sooner", n - 1))),
                       F.concat(F.lit("<2 "), plain(F.get("sooner", n - 2)), F.lit(" "), plain(F.get("sooner", n - 1))),
                       F.concat(F.lit(">1 "), plain(F.col("later"))))
    core = F.regexp_replace("match", f"^{MARKS}++", "")
    lead = F.length("match") - F.length(core)
    inner = F.regexp_replace(core, f"(?<!{MARKS}){MARKS}++$", "")
    each = (_placed(rows, "instance", near)
            .select("row_id", inner.alias("match"), (F.col("start") + lead).alias("start"), (F.col("start") + lead + F.length(inner)).alias("end"),
                    F.filter(patterns, lambda p: p.isNotNull()).alias("patterns")))
    events = (each.select("*", (F.col("end") - 1).alias("at"), F.lit(True).alias("mine"), F.lit(None).cast("boolean").alias("holds"))
              .unionByName(found.select("row_id", "start", "end", F.col("start").alias("at"), F.lit(False).alias("mine"), "holds"), allowMissingColumns=True))
    # A match overlaps an instance if it starts before the instance ends and ends after its start.
    so_far = W.partitionBy("row_id").orderBy("at", "mine").rowsBetween(W.unboundedPreceding, 0)
    reach = {c: F.coalesce(F.max(F.when(~F.col("mine") & (F.col("holds") == h), F.col("end"))).over(so_far), F.lit(0)) for c, h in (("good", True), ("bad", False))}
    return (events.withColumns(reach).where("mine").withColumn("known", F.col("good") > F.col("start"))
            .select("row_id", "match", "start", "end", "known", (~F.col("known") & (F.col("bad") > F.col("start"))).alias("failed"), "patterns"))


def bootstrap(instances: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """match, best (confidence of its best pattern) of every distinct instance that has one."""
    edges = cut(instances.select("match", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    fixed = (F.when(F.max("known") | F.col("match").rlike(SECRET), 1.0).when(F.max("failed"), 0.0))
    score = cut(instances.groupBy("match").agg(fixed.alias("fixed")).withColumn("score", F.coalesce("fixed", F.lit(0.0))).withColumn("best", F.lit(None).cast("double")), "pii-score")
    for _ in range(rounds):
        confidence = (edges.join(score.select("match", "score"), "match").groupBy("pattern")
                      .agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.count(F.when(F.col("score") >= ACCEPT, 1)).alias("sure"))
                      .where(F.col("sure") >= min_seeds).select("pattern", "confidence"))
        best = edges.join(confidence, "pattern").groupBy("match").agg(F.max("confidence").alias("best"))
        score = cut(score.drop("best").join(best, "match", "left").select("match", "fixed", F.coalesce("fixed", "best", F.lit(0.0)).alias("score"), "best"), "pii-score")
    return score.where(F.col("best").isNotNull()).select("match", "best")


def find_personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end, by kind and start) of every row."""
    rows = matches(docs)
    tried = cut(base_matches(rows), "pii-base")
    base = tried.where("holds").drop("holds")
    instances = cut(_instances(rows, tried), "pii-instances")
    new = bootstrap(instances).where(F.col("best") >= accept).select("match")
    found = (instances.where(~F.col("known") & ~F.col("failed") & (F.length("match") >= MIN_LENGTH)).join(new, "match")
             .select("row_id", F.lit(len(KINDS)).alias("kind"), "start", "end"))
    spans = (base.union(found).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("spans")))   # those of one text
    names = F.array(*[F.lit(k) for k in [*KINDS, FOUND]])
    out = rows.select("row_id", "doc_id").join(spans, "row_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))
    named = F.transform("spans", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select("doc_id", named.alias("spans")).withColumn("base", F.filter("spans", lambda s: s["kind"] != FOUND))


def span_text(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
