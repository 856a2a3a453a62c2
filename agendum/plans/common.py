"""Helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

# Sums and logs of doubles agree across engines to ~1e-9, not bit for bit,
# so every DOUBLE in a query result is rounded to this many decimals.
DECIMALS = 6


def rounded(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), decimals).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
