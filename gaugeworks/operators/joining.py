"""Joins with stated cardinality, and near-duplicate joins on hashes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.hamming import near_hashes


def first_row(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key in a stated order (an arbitrary one is never taken)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def left_first(rows: DataFrame, more: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """Left join to the first row of each key, so the left side's rows stay as many as they are."""
    return rows.join(first_row(more, [key], order), key, "left")


def three_way(meta: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """meta with both arms, inner on both; raises if nothing is left."""
    joined = meta.join(a.select(key, F.col("correct").alias("correct_a")), key).join(b.select(key, F.col("correct").alias("correct_b")), key)
    if joined.isEmpty():
        raise ValueError("the tables have no key in common")
    return joined


def agreement(rows: DataFrame, control: str, scorers: Sequence[str]) -> DataFrame:
    """For each scorer: agreement with the control, and how often only one of the two is right."""
    wide = rows.agg(
        *(F.avg((F.col(s) == F.col(control)).cast("double")).alias(f"{s}_agree") for s in scorers),
        *(F.count_if((F.col(s) == 1) & (F.col(control) == 0)).alias(f"{s}_only") for s in scorers),
        *(F.count_if((F.col(s) == 0) & (F.col(control) == 1)).alias(f"{s}_lost") for s in scorers),
    )
    each = F.array(*(F.struct(F.lit(s).alias("scorer"), F.col(f"{s}_agree").alias("agree"), F.col(f"{s}_only").alias("only_scorer"), F.col(f"{s}_lost").alias("only_control")) for s in scorers))
    return wide.select(F.explode(each).alias("e")).select("e.*")


def upsert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and the new ones whose key isn't there yet; running it twice changes nothing."""
    return old.unionByName(new.join(old, list(keys), "left_anti"))


def close_hashes(left: DataFrame, right: DataFrame, key: str, other: str, bits: int) -> DataFrame:
    """Pairs of 64-bit hashes (column ``h``) that differ in at most ``bits`` bits, by the index of ``hamming``.

    Equal hashes are taken together first on both sides, so copies do not multiply in the
    join; the result has every pair of rows (``close_summary`` has one row for each of the left).
    """
    a = left.select(key, F.col("h").alias("h1"))
    b = right.select(F.col(key).alias(other), F.col("h").alias("h2"))
    return near_hashes(left, right, bits).join(a, "h1").join(b, "h2").select(key, other, "distance")


def close_summary(left: DataFrame, right: DataFrame, key: str, bits: int) -> DataFrame:
    """One row for each row of ``left``: key, n_close, nearest distance to another text, and the least key of its hash in ``right``.

    ``n_close`` counts the rows of ``right`` within ``bits`` bits, with ``n_equal`` of the
    very hash.  Copies are counted, never expanded into pairs.
    """
    whole = right.groupBy(F.col("h").alias("h2")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    distance = F.col("distance")
    found = near_hashes(left, right, bits).join(whole, "h2").groupBy("h1").agg(
        F.sum("n").alias("n_close"),
        F.sum(F.when(distance == 0, F.col("n")).otherwise(0)).alias("n_equal"),
        F.min(F.when(distance > 0, distance)).alias("nearest"),
        F.min("first").alias("least"),
    )
    zero = F.lit(0).cast("long")
    joined = left.select(key, F.col("h").alias("h1")).join(found, "h1", "left")
    return joined.select(key, F.coalesce("n_close", zero).alias("n_close"), F.coalesce("n_equal", zero).alias("n_equal"), "nearest", F.col("least").alias("least_close"))


def join_rate(wanted: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """n, found, join_rate: how many of the wanted rows have a member."""
    there = members.select(key).distinct().withColumn("_there", F.lit(1))
    done = wanted.join(there, key, "left").agg(F.count(F.lit(1)).alias("n"), F.count("_there").alias("found"))
    return done.withColumn("join_rate", F.try_divide(F.col("found"), F.col("n")))


def resumed(rows: DataFrame, done: DataFrame, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an earlier run has done, and ``make`` of the rows it has not; done twice counts once."""
    todo = rows.join(done.select(key), key, "left_anti")
    return done.dropDuplicates([key]).unionByName(make(todo))
