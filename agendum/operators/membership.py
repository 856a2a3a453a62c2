"""Group membership change feed (J8, U6, U7) as set-based joins.

A batch of change requests is judged against the membership snapshot taken
before the batch: ADMIN check (semi join on (group, requester)), target lookup
by e-mail (join on users), current membership (join on (group, user)). The
accepted operations are reduced to the last one per (group, user) and merged
into the snapshot with one full outer join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agendum.functions.expressions import ROLES
from agendum.operators.relational import latest_by_key, with_authorization


def new_group_id(change_id: str = "change_id"):
    """Surrogate id of a group created by a change: negative, so it never
    collides with existing (non-negative) ids and reruns agree."""
    return -F.col(change_id) - F.lit(1)


def judge_changes(members: DataFrame, users: DataFrame, changes: DataFrame) -> DataFrame:
    """Every change with ``target_user_id``, ``authorized`` and
    ``reject_reason`` (NULL when accepted)."""
    u = users.select(F.col("email"), F.col("user_id").alias("target_user_id"))
    cur = members.select("group_id", F.col("user_id").alias("target_user_id"),
                         F.col("role").alias("current_role"))
    j = (with_authorization(changes, members)
                .join(u, "email", "left")
                .join(cur, ["group_id", "target_user_id"], "left"))
    act = F.col("action")
    reason = (F.when(act == "create", F.lit(None).cast("string"))
               .when(~F.col("authorized"), F.lit("not_admin"))
               .when(F.col("target_user_id").isNull(), F.lit("unknown_email"))
               .when((act == "invite") & F.col("current_role").isNotNull(), F.lit("already_member"))
               .when(act.isin("role", "remove") & F.col("current_role").isNull(), F.lit("not_member"))
               .when((act == "role") & ~F.col("new_role").isin(*ROLES), F.lit("bad_role"))
               .when(~act.isin("create", "invite", "role", "remove"), F.lit("bad_action")))
    return j.withColumn("reject_reason", reason)


def accepted_ops(judged: DataFrame) -> DataFrame:
    """(group_id, user_id, change_id, op_role, is_delete) for accepted changes."""
    a = judged.filter(F.col("reject_reason").isNull())
    act = F.col("action")
    return a.select(
        F.when(act == "create", new_group_id()).otherwise(F.col("group_id")).alias("group_id"),
        F.when(act == "create", F.col("requester_id")).otherwise(F.col("target_user_id")).alias("user_id"),
        "change_id",
        F.when(act == "create", F.lit("ADMIN")).when(act == "invite", F.lit("MEMBER"))
         .when(act == "role", F.col("new_role")).alias("op_role"),
        (act == "remove").alias("is_delete"))


def apply_membership(members: DataFrame, users: DataFrame, changes: DataFrame) -> DataFrame:
    """Membership snapshot after the batch (last accepted change per
    (group, user) wins, by change id)."""
    ops = latest_by_key(accepted_ops(judge_changes(members, users, changes)),
                        ["group_id", "user_id"], ["change_id"])
    j = members.join(ops, ["group_id", "user_id"], "full_outer")
    return (j.filter(~F.coalesce("is_delete", F.lit(False)))
             .select("group_id", "user_id", F.coalesce("op_role", "role").alias("role")))


def membership_rejects(members: DataFrame, users: DataFrame, changes: DataFrame) -> DataFrame:
    return (judge_changes(members, users, changes).filter(F.col("reject_reason").isNotNull())
            .select("change_id", "action", "group_id", "requester_id", "reject_reason"))


def remove_members(members: DataFrame, users: DataFrame, changes: DataFrame) -> DataFrame:
    """Delete the memberships named by accepted ``remove`` changes."""
    ops = accepted_ops(judge_changes(members, users, changes)).filter(F.col("is_delete"))
    return members.join(ops.select("group_id", "user_id"), ["group_id", "user_id"], "left_anti")
