"""Joins in which no frequent key is one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most, and parts that the rows of those are dealt into where others are shuffled.
BROADCAST_KEYS = 200_000
SALTS = 4096


def split_join(left: DataFrame, right: DataFrame, keys: list[str], n_rows: str, salt: list[str], at_most: int, most: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and says how many rows of ``left`` have it.

    ``right`` has ``at_most`` rows.  If these are no more than ``most`` (``BROADCAST_KEYS``)
    it is broadcast.  Of a larger table, the keys of more than a ``most``-th of all rows
    (so no more of them than that) are matched on the map side; the others by shuffling,
    where rows that have their match are dealt by columns ``salt`` and no key has many.
    Keys are not null; rows of ``left`` without a match are dropped.
    """
    most = most or BROADCAST_KEYS
    values = [c for c in right.columns if c not in keys and c != n_rows]
    if at_most <= most:
        return left.join(F.broadcast(right.select(*keys, *values)), keys)
    total = right.agg(F.coalesce(F.sum(n_rows), F.lit(0))).first()[0]
    often = F.col(n_rows) * F.lit(most) > F.lit(total)
    cold = right.filter(~often).select(*keys, *(F.struct(v).alias(f"cold_{v}") for v in values), F.lit(0).alias("salt"))
    hot = right.filter(often).select(*keys, *(F.struct(v).alias(f"hot_{v}") for v in values), F.lit(True).alias("met"))
    spread = F.when(F.col("met"), F.pmod(F.xxhash64(*salt), F.lit(SALTS)) + 1).otherwise(F.lit(0)).cast("int")
    met = left.join(F.broadcast(hot), keys, "left").withColumn("salt", spread).join(cold, [*keys, "salt"], "left")
    found = {v: F.coalesce(f"hot_{v}", f"cold_{v}") for v in values}
    some = F.lit(False)
    for x in found.values():
        some = some | x.isNotNull()
    return met.filter(some).select(*left.columns, *(x[v].alias(v) for v, x in found.items()))
