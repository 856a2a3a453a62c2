"""Order-insensitive comparison of a Spark result with an oracle result
(both as Arrow tables): column names, simple types, and the multiset of rows
with DOUBLE values compared at 6 decimals."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import pyarrow as pa

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def simple_type(t: pa.DataType) -> str:
    if pa.types.is_string(t) or pa.types.is_large_string(t) or pa.types.is_string_view(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp" + ("tz" if t.tz else "")
    if pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_list_view(t):
        return "list<" + simple_type(t.value_type) + ">"
    return str(t)


def rows(tbl: pa.Table):
    names = sorted(tbl.column_names)
    tbl = tbl.select(names)
    cols = [tbl.column(n).to_pylist() for n in names]
    return names, Counter(tuple(norm(c[i]) for c in cols) for i in range(tbl.num_rows))


def compare(s_tbl: pa.Table, d_tbl: pa.Table) -> list[str]:
    """Problems found (empty list = match)."""
    s_names, s_rows = rows(s_tbl)
    d_names, d_rows = rows(d_tbl)
    problems = []
    if s_names != d_names:
        problems.append(f"columns spark={s_names} duck={d_names}")
    if s_tbl.num_rows != d_tbl.num_rows:
        problems.append(f"rows spark={s_tbl.num_rows} duck={d_tbl.num_rows}")
    s_types = {f.name: simple_type(f.type) for f in s_tbl.schema}
    d_types = {f.name: simple_type(f.type) for f in d_tbl.schema}
    tdiff = {n: (s_types.get(n), d_types.get(n)) for n in s_names if s_types.get(n) != d_types.get(n)}
    if tdiff:
        problems.append(f"types {tdiff}")
    if not problems and s_rows != d_rows:
        only_s = list((s_rows - d_rows).elements())[:3]
        only_d = list((d_rows - s_rows).elements())[:3]
        problems.append(f"values differ; spark-only {only_s} duck-only {only_d}")
    return problems


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con
