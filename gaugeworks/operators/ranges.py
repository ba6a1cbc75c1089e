"""Places and running totals over whole tables, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.sources import folders


def running_totals(rows: DataFrame, order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """``rows`` with, for each (name, value) of ``values``, the total of column ``value`` up to and with the row.

    ``order`` names columns, with ``-`` before those that fall.  Rows are dealt into ranges
    and written; each range is summed by itself and set off by the totals of those before
    it (one row a range), so ties must be broken by the order.
    """
    by = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order]
    path = folders.fresh_path(rows.sparkSession, "ranges")
    dealt = rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    written = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = written.groupBy("_range").agg(*(F.sum(v).alias(f"_of_{n}") for n, v in values.items()))
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_of_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in values))
    inside = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    return written.join(starts, "_range").select(*rows.columns, *((F.sum(v).over(inside) + F.col(f"_start_{n}")).alias(n) for n, v in values.items()))


def place_within(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with the place, from 1, of each row within its key, by ``order``: no key is one task, however many rows it has."""
    placed = running_totals(rows.withColumn("_one", F.lit(1)), [*keys, *order], {"_total": "_one"})
    least = placed.groupBy(*keys).agg(F.min("_total").alias("_least"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"l.{k}"))
    joined = placed.alias("p").join(least.alias("l"), same)
    return joined.select(*(F.col(f"p.{c}") for c in rows.columns), (F.col("_total") - F.col("_least") + 1).alias(name))
