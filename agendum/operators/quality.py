"""Schema constraints run as jobs (Q1-Q3). Each check is an aggregate or an
anti join; results are unioned, one row per check (or per violating key)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 500_000   # keys that one task counts


def check_unique(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Q1: keys that occur more than once: (check, key, n).

    Most keys occur once, so the tables of groups are as long as the input: keys
    are dealt over tasks by the number of rows, which bounds those of a task."""
    out = None
    for name, (df, keys) in tables.items():
        dealt = df.select(*keys).repartition(max(1, -(-df.count() // ROWS_PER_TASK)), *keys)
        d = (dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
               .select(F.lit(name).alias("check"),
                       F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "n"))
        out = d if out is None else out.unionByName(d)
    return out


def check_orphans(checks: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str]]]) -> DataFrame:
    """Q2: rows whose foreign key has no parent: (check, orphan_rows).
    NULL keys are not orphans (optional relations)."""
    out = None
    for name, (child, parent, keys) in checks.items():
        c = child.select(*keys).dropna()
        d = (c.join(parent.select(*keys), list(keys), "left_anti")
               .agg(F.count(F.lit(1)).alias("orphan_rows"))
               .select(F.lit(name).alias("check"), "orphan_rows"))
        out = d if out is None else out.unionByName(d)
    return out


def check_domain(checks: Mapping[str, tuple[DataFrame, str, Sequence[str], bool]]) -> DataFrame:
    """Q3: values outside an enum, and NULLs where the column is required:
    (check, violations)."""
    out = None
    for name, (df, col, domain, required) in checks.items():
        bad = ~F.coalesce(F.col(col).isin(*domain), F.lit(not required))
        d = (df.agg(F.sum(bad.cast("long")).alias("v"))
               .select(F.lit(name).alias("check"), F.coalesce("v", F.lit(0)).cast("long").alias("violations")))
        out = d if out is None else out.unionByName(d)
    return out
