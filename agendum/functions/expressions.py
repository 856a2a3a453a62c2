"""Column expressions used inside operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Ticket status domain and user roles (must equal the reference's enums).
TICKET_STATUSES = ("TODO", "IN_PROGRESS", "DONE")
ROLES = ("ADMIN", "MEMBER")
# Default blocker pattern: English word or the Korean word for "block".
DEFAULT_BLOCKER_PATTERN = "(?i)blocker|차단"
# Weights of the productivity score: actionable tickets, all tickets.
ACTIONABLE_WEIGHT = 0.6
TICKET_WEIGHT = 0.4
# Whitespace named explicitly so JVM regex and RE2 split identically.
WHITESPACE_PATTERN = "[ \\t\\n\\r\\f\\x0B]+"
# ---------------------------------------------------------------------------


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_actionable(status: str | Column = "status") -> Column:
    """1 when the status is anything but TODO; NULL status counts 0."""
    return F.when(col_(status) != F.lit("TODO"), F.lit(1)).otherwise(F.lit(0))


def mentions_blocker(content: str | Column = "content",
                     pattern: str = DEFAULT_BLOCKER_PATTERN) -> Column:
    """1 when the text matches the blocker pattern, else 0."""
    return F.when(col_(content).rlike(pattern), F.lit(1)).otherwise(F.lit(0))


def map_values(c: str | Column, mapping: dict, default=None) -> Column:
    """CASE WHEN c = k THEN v ... ELSE default, kept as one codegen'd CASE."""
    expr = None
    for k, v in mapping.items():
        cond = col_(c) == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(default))


def score(actionable: str | Column, tickets: str | Column) -> Column:
    """Weighted productivity score on DOUBLE literals."""
    return (col_(actionable).cast("double") * F.lit(ACTIONABLE_WEIGHT)
            + col_(tickets).cast("double") * F.lit(TICKET_WEIGHT))


def round6(c: str | Column) -> Column:
    return F.round(col_(c).cast("double"), 6)


def tokens(text: str | Column) -> Column:
    """Lower-case text split on whitespace, blanks removed."""
    parts = F.split(F.lower(col_(text)), WHITESPACE_PATTERN)
    return F.filter(parts, lambda t: t != F.lit(""))


def preview(text: str | Column, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(col_(text), 1, n)


def blank_to_null(c: str | Column) -> Column:
    """JS falsy string: NULL or '' become NULL."""
    return F.nullif(col_(c), F.lit(""))
