"""Adjacent rows, timelines and time-nearest rows within a cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjacent_pairs(rows: DataFrame, cluster: str, time: str, key: str, value: str) -> DataFrame:
    """Neighbouring rows of a cluster in time order: gap, jump (absolute change), NULL values skipped afterwards."""
    order = Window.partitionBy(cluster).orderBy(time, key)
    done = rows.select(
        cluster, key, time, value, F.lag(key).over(order).alias("before"), (F.col(time) - F.lag(time).over(order)).alias("gap"), F.abs(F.col(value) - F.lag(value).over(order)).alias("jump")
    )
    return done.filter("before is not null and jump is not null")


def gap_buckets(pairs: DataFrame, edges: Sequence[float], gap: str = "gap", jump: str = "jump", large: float = 3.0) -> DataFrame:
    """n, mean jump, share without a jump, share of large jumps and the largest, by half-open (lo, hi] gap."""
    bucket = F.lit(None).cast("string")
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        bucket = F.when((F.col(gap) > lo) & (F.col(gap) <= hi), F.lit(f"({lo:g},{hi:g}]")).otherwise(bucket)
    j = F.col(jump)
    return pairs.withColumn("bucket", bucket).filter("bucket is not null").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg(j).alias("mean_jump"), F.avg((j == 0).cast("double")).alias("same"), F.avg((j >= large).cast("double")).alias("large"), F.max(j).alias("max_jump")
    )


def timeline_states(rows: DataFrame, cluster: str, time: str, present: Column) -> DataFrame:
    """state: ABSENT before the cluster's first event, PRESENT where annotated, else UNKNOWN."""
    first = F.min(F.when(present, F.col(time))).over(Window.partitionBy(cluster))
    return rows.withColumn("first_event", first).withColumn(
        "state", F.when(F.col("first_event").isNull() | (F.col(time) < F.col("first_event")), "ABSENT").when(present, "PRESENT").otherwise("UNKNOWN")
    )


def before_first_event(rows: DataFrame, cluster: str, time: str, event: Column) -> DataFrame:
    """Rows strictly before their cluster's first event; clusters without one have none."""
    first = F.min(F.when(event, F.col(time))).over(Window.partitionBy(cluster))
    return rows.withColumn("first_event", first).filter(F.col(time) < F.col("first_event"))


def nearest_in_time(rows: DataFrame, cluster: str, time: str, key: str, k: int, reach: int = 64) -> DataFrame:
    """key, neighbour, gap, place: the k rows of the cluster nearest in time; ties go to the lower key.

    The k nearest lie among the lowest k + 1 keys of the row's own time and of the k distinct
    times either side, so only those are looked at: no self-join, and rows at one moment
    do not widen the windows.  Rows without a time come last, in order of their keys.
    """
    if k > reach:
        raise ValueError("k is beyond the reach")
    rows = rows.select(cluster, key, time)

    def lowest(some: DataFrame, *by: str) -> DataFrame:
        number = F.row_number().over(Window.partitionBy(*by).orderBy(key))
        first = some.withColumn("_number", number).filter(F.col("_number") <= k + 1)
        return first.groupBy(*by).agg(F.collect_list(F.struct(F.col(time).alias("t"), F.col(key).alias("o"))).alias("near"))

    dated, undated = rows.filter(F.col(time).isNotNull()), rows.filter(F.col(time).isNull())
    around = F.flatten(F.collect_list("near").over(Window.partitionBy(cluster).orderBy(time).rowsBetween(-k, k)))
    cells = lowest(dated, cluster, time).select(cluster, time, around.alias("near"))
    last = lowest(undated, cluster).withColumnRenamed("near", "last")
    near = F.when(F.col("last").isNull(), F.col("near")).otherwise(F.concat("near", "last"))
    of_dated = dated.join(cells, [cluster, time]).join(last, cluster, "left").select(cluster, key, time, near.alias("near"))
    of_undated = undated.join(lowest(rows, cluster), cluster).select(cluster, key, time, "near")

    def candidate(x: Column) -> Column:
        gap = F.abs(x["t"] - F.col(time))
        return F.struct(gap.isNull().alias("undated"), gap.alias("gap"), x["o"].alias("neighbour"))

    others = F.transform(F.filter("near", lambda x: x["o"] != F.col(key)), candidate)
    nearest = of_dated.unionByName(of_undated).select(cluster, key, F.posexplode(F.slice(F.array_sort(others), 1, k)).alias("at", "x"))
    return nearest.select(cluster, key, "x.neighbour", "x.gap", (F.col("at") + 1).alias("place"))


def running_rate(rows: DataFrame, group: str, time: str, key: str, width: int = 64) -> DataFrame:
    """Rows per second over the trailing ``width`` rows of each group."""
    order = Window.partitionBy(group).orderBy(time, key)
    frame = order.rowsBetween(-(width - 1), 0)
    span = F.col(time) - F.min(time).over(frame)
    return rows.select(group, key, time, F.try_divide(F.count(F.lit(1)).over(frame) - 1, span).alias("rate"))


def sessions(rows: DataFrame, group: str, time: str, key: str, gap: float) -> DataFrame:
    """session number (from 1) of every row: a new one after a pause longer than ``gap``."""
    order = Window.partitionBy(group).orderBy(time, key)
    opens = F.coalesce((F.col(time) - F.lag(time).over(order) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")
