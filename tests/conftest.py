from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from agendum.session import build_session, checkpoint_dir
    s = build_session("local[4]", app="agendum-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "4g"})
    checkpoint_dir(s)   # local run with no spark.checkpoint.dir: a scratch folder of its own
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL_SF


def rows_of(df, cols=None, sort=True):
    cols = cols or df.columns
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=row_key) if sort else out


def row_key(t):
    """Sort key for result rows: NULLs last, values in their natural order."""
    return tuple((1, 0) if x is None else (0, x) for x in t)
