"""The tables the queries read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with underscores before it until no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def row_digest(df: DataFrame) -> Column:
    """A digest of all columns of a row, of whatever types: equal rows have equal ones."""
    return F.sha2(F.to_json(F.struct(*df.columns)), 256)
