"""Rounding of result columns, so that sums in another order give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns))
