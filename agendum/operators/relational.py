"""Relational reads, joins and table changes.

Joins are declared as plain equi-joins: AQE picks broadcast from measured
shuffle sizes and splits skewed partitions, so no side is broadcast on a guess.
Fixed, tiny lookups (status moves, lexicons) are expressions, not joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agendum.functions.expressions import ROLES, blank_to_null


# -- P1-P4: read paths -------------------------------------------------------

def realtime_for_meeting(metrics: DataFrame, meeting_id: int) -> DataFrame:
    """Metric rows of one meeting, newest window first. The filter is
    pushed into the scan by Catalyst."""
    return metrics.filter(F.col("meeting_id") == F.lit(meeting_id)).orderBy(
        F.col("window_start").desc(), F.col("window_end").desc())


def patterns_for_meeting(patterns: DataFrame, meeting_id: int, order_col: str = "analysis_date") -> DataFrame:
    """Ticket pattern rows of one meeting, newest first."""
    return patterns.filter(F.col("meeting_id") == F.lit(meeting_id)).orderBy(F.col(order_col).desc())


def hourly_patterns(patterns: DataFrame) -> DataFrame:
    """Hour-of-day pattern rows in ascending hour."""
    return patterns.orderBy("hour_of_day")


def list_meetings(meetings: DataFrame, ts: str = "created_at") -> DataFrame:
    """Meetings newest first, meeting id as tie-break."""
    return meetings.orderBy(F.col(ts).desc(), F.col("meeting_id"))


# -- P10: row rules ----------------------------------------------------------

def validate_rows(df: DataFrame, name: str = "name", email: str = "email",
                  role: str | None = "role") -> DataFrame:
    """P10: non-blank name, '@' in e-mail, role in the enum. Adds
    ``is_valid`` and the first failing rule as ``reject_reason``."""
    checks: list[tuple[Column, str]] = [
        (F.coalesce(F.trim(F.col(name)), F.lit("")) == "", "blank_name"),
        (F.coalesce(F.instr(F.col(email), "@"), F.lit(0)) == 0, "bad_email"),
    ]
    if role:
        checks.append((~F.coalesce(F.col(role).isin(*ROLES), F.lit(False)), "bad_role"))
    reason = None
    for cond, label in checks:
        reason = F.when(cond, F.lit(label)) if reason is None else reason.when(cond, F.lit(label))
    return (df.withColumn("reject_reason", reason.otherwise(F.lit(None).cast("string")))
              .withColumn("is_valid", F.col("reject_reason").isNull()))


# -- J3-J8: joins -------------------------------------------------------------

def tickets_with_assignee(tickets: DataFrame, users: DataFrame) -> DataFrame:
    """Every ticket with its assignee's name (left join)."""
    u = users.select(F.col("user_id").alias("assignee_id"), F.col("name").alias("assignee_name"))
    return tickets.join(u, "assignee_id", "left")


def user_groups(groups: DataFrame, members: DataFrame, user_ids: DataFrame | None = None) -> DataFrame:
    """Groups having at least one member (or one of ``user_ids``): a
    semi join, never a row multiplication."""
    m = members if user_ids is None else members.join(user_ids, "user_id", "left_semi")
    return groups.join(m.select("group_id"), "group_id", "left_semi")


def groups_with_members(groups: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """Group → member → user include, flattened to one row per
    membership (an array per group would put a whole group in one row).
    ``member_count`` comes from a per-group aggregate joined back."""
    mu = members.join(users.select("user_id", F.col("name").alias("user_name")), "user_id", "left")
    counts = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("member_count"))
    g = groups.select("group_id", F.col("name").alias("group_name")).join(counts, "group_id", "left")
    return (g.join(mu, "group_id", "left")
             .select("group_id", "group_name", F.coalesce("member_count", F.lit(0)).alias("member_count"),
                     "user_id", "user_name", "role"))


def group_member_names(members: DataFrame, users: DataFrame) -> DataFrame:
    """Member names with 'Unknown' for a missing or empty name."""
    return (members.join(users.select("user_id", "name"), "user_id", "left")
            .select("group_id", "user_id",
                    F.coalesce(blank_to_null(F.col("name")), F.lit("Unknown")).alias("name")))


def authorized_changes(changes: DataFrame, members: DataFrame,
                       requester: str = "requester_id") -> tuple[DataFrame, DataFrame]:
    """Split changes into those whose requester is an ADMIN of the group
    (semi join) and the rest (anti join); ``with_authorization`` flags them in one join."""
    admins = (members.filter(F.col("role") == "ADMIN")
              .select("group_id", F.col("user_id").alias(requester)))
    ok = changes.join(admins, ["group_id", requester], "left_semi")
    denied = changes.join(admins, ["group_id", requester], "left_anti")
    return ok, denied


def with_authorization(changes: DataFrame, members: DataFrame, requester: str = "requester_id") -> DataFrame:
    """``authorized``: the requester is an ADMIN of the group. One left join."""
    admins = (members.filter(F.col("role") == "ADMIN")
              .select("group_id", F.col("user_id").alias(requester), F.lit(True).alias("authorized")).distinct())
    return (changes.join(admins, ["group_id", requester], "left")
            .withColumn("authorized", F.coalesce("authorized", F.lit(False))))


# -- L2, L3 ---------------------------------------------------------------------

def meeting_groups(meetings: DataFrame) -> DataFrame:
    """Distinct (meeting_id, group_id). The meeting table has one row per
    audio, so every join from meetings to groups goes through this."""
    return meetings.select("meeting_id", "group_id").distinct()


def first_row(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """L2: deterministic "find first": the row with the smallest ``order_col``
    per key (``min_by`` aggregates map-side, so hot keys are cheap)."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order_col)).alias("r"))
              .select(*keys, "r.*"))


def recent(df: DataFrame, ts: str, k: int, tiebreak: Sequence[str]) -> DataFrame:
    """L3: top-k newest rows; Spark plans a per-partition top-k then a merge."""
    return df.orderBy(F.col(ts).desc(), *[F.col(c) for c in tiebreak]).limit(k)


# -- U1-U6: table changes --------------------------------------------------------

def latest_by_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Newest row per key by ``order_cols`` (a total order per key).
    ``max_by`` is a map-side-combinable aggregate: no window, no hot task."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in order_cols])
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
              .select(*keys, "r.*"))


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str],
           update_cols: Sequence[str], insert_only: Sequence[str] = ()) -> DataFrame:
    """Insert-or-update by key. ``changes`` must hold one row per key
    (use ``latest_by_key`` first). Updated columns take the change's value when
    it is not NULL; insert-only columns keep the base value when present.
    Idempotent: applying the same changes twice gives the same table."""
    c = changes.select(*keys, *[F.col(x).alias(f"__c_{x}") for x in changes.columns if x not in keys])
    j = base.join(c, list(keys), "full_outer")
    out = []
    for x in base.columns:
        if x in keys:
            out.append(F.col(x))
        elif x in update_cols and f"__c_{x}" in j.columns:
            out.append(F.coalesce(F.col(f"__c_{x}"), F.col(x)).alias(x))
        elif f"__c_{x}" in j.columns:
            out.append(F.coalesce(F.col(x), F.col(f"__c_{x}")).alias(x))
        else:
            out.append(F.col(x))
    return j.select(*out)


def patch(base: DataFrame, patches: DataFrame, order_cols: Sequence[str], key: str = "ticket_id",
          keep_if_blank: Sequence[str] = ("title", "content", "status"),
          nullable: Sequence[str] = ("assignee_id",)) -> DataFrame:
    """Partial updates of existing rows, any number per key, folded in
    ``order_cols`` order (total per key). Each column takes the value of the
    last patch that sets it: a blank or absent value sets nothing; columns in
    ``nullable`` are set by the patches with ``has_<col>`` (so an explicit NULL
    clears them). Unknown keys are ignored. ``status_updates`` counts the
    patches that set a status.

    One map-side-combinable ``max_by`` per column, so a hot key costs one row
    per input partition."""
    order = F.struct(*[F.col(c) for c in order_cols])
    aggs = []
    for c in keep_if_blank:
        if c in patches.columns:
            given = blank_to_null(F.col(c))
            aggs.append(F.max_by(given, F.when(given.isNotNull(), order)).alias(f"__p_{c}"))
    for c in nullable:
        if f"has_{c}" in patches.columns:
            aggs.append(F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(f"has_{c}"), order)).alias(f"__p_{c}"))
    sets_status = blank_to_null(F.col("status")).isNotNull() if "status" in patches.columns else F.lit(False)
    aggs.append(F.count_if(sets_status).alias("__p_n"))
    j = base.join(patches.groupBy(key).agg(*aggs), key, "left")
    out = []
    for x in base.columns:
        p = f"__p_{x}"
        if p not in j.columns:
            out.append(F.col(x))
        elif x in nullable:
            out.append(F.when(F.col(p).isNotNull(), F.col(p)["v"]).otherwise(F.col(x)).alias(x))
        else:
            out.append(F.coalesce(F.col(p), F.col(x)).alias(x))
    return j.select(*out, F.coalesce("__p_n", F.lit(0)).alias("status_updates"))


def patch_events(base: DataFrame, patches: DataFrame, key: str = "ticket_id") -> DataFrame:
    """The update events: one per patch that sets a status of an existing
    row, with the row's meeting and the status the patch sets."""
    rows = base.select(key, "meeting_id")
    return (patches.withColumn("status", blank_to_null(F.col("status"))).filter(F.col("status").isNotNull())
            .join(rows, key))


def union_all(*dfs: DataFrame) -> DataFrame:
    """U4: concatenate by column name (UNION ALL)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def remove_rows(df: DataFrame, removals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete by key (anti join)."""
    return df.join(removals.select(*keys), list(keys), "left_anti")


def new_tickets(rows: DataFrame, id_parts: Sequence[str], ts: str = "created_at") -> DataFrame:
    """Insert with defaults: status TODO when absent, ``updated_at`` =
    creation time, and an id hashed from the row's natural key so a rerun
    produces the same ids (no random UUIDs)."""
    # concat_ws skips NULLs, which would let different rows share an id
    tid = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_parts]), 256)
    return rows.select(tid.alias("ticket_id"), "meeting_id", "title", "content",
                       F.coalesce(F.col("status"), F.lit("TODO")).alias("status"),
                       "assignee_id", F.col(ts).alias("created_at"), F.col(ts).alias("updated_at"))


def dedup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Z4 (batch twin): one row per event id; repeated deliveries are equal rows."""
    return df.dropDuplicates(list(keys))
