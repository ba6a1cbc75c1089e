"""Gates: checks that raise.  Each costs one aggregate and hands its table on unchanged."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A table doesn't hold what it must."""


def require(rows: DataFrame, what: str, holds: Column) -> DataFrame:
    """Every row must satisfy ``holds`` (NULL does not)."""
    n = rows.agg(F.count_if(~F.coalesce(holds, F.lit(False)))).first()[0]
    if n:
        raise GateError(f"{what}: {n} rows")
    return rows


def unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(5).collect()
    if bad:
        raise GateError(f"repeated {list(keys)}: {[tuple(r)[:-1] for r in bad]}")
    return rows


def bounded_groups(rows: DataFrame, keys: Sequence[str], most: int = 1_000_000) -> DataFrame:
    """Raises where a key has more than ``most`` rows: for tables whose groups become one value each."""
    largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise GateError(f"a key of {list(keys)} has {largest} rows, at most {most}")
    return rows


def functional(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each key has one value: returns the map, or raises."""
    done = rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_most"))
    bad = done.filter(F.col(value) != F.col("_most")).limit(5).collect()
    if bad:
        raise GateError(f"{key} has several values of {value}: {[r[0] for r in bad]}")
    return done.drop("_most")


def contained(rows: DataFrame, whole: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = rows.join(whole, list(keys), "left_anti").limit(5).collect()
    if bad:
        raise GateError(f"unknown {list(keys)}: {[tuple(r[k] for k in keys) for r in bad]}")
    return rows


def disjoint(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = a.select(*keys).intersect(b.select(*keys)).limit(5).collect()
    if bad:
        raise GateError(f"in both tables: {[tuple(r) for r in bad]}")
    return a


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    contained(a, b, keys)
    contained(b, a, keys)
    return a


def share_at_most(rows: DataFrame, what: str, flag: Column, most: float) -> DataFrame:
    share = rows.agg(F.avg(flag.cast("double"))).first()[0]
    if share is not None and share > most:
        raise GateError(f"{what}: a share of {share:.4f}, at most {most}")
    return rows


def counts_are(rows: DataFrame, keys: Sequence[str], expected: dict[tuple, int]) -> DataFrame:
    """Exact counts of every cell, with none missing and none besides; for a stated, small set of cells."""
    found = {tuple(r)[:-1]: r["n"] for r in rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).limit(len(expected) + 1).collect()}
    if found != expected:
        raise GateError(f"cells differ: {sorted(set(found.items()) ^ set(expected.items()), key=str)[:5]}")
    return rows


def floors_hold(report: DataFrame) -> DataFrame:
    """0 <= floor <= 1, and margin = accuracy - floor."""
    floor, margin = F.col("floor"), F.col("margin")
    return require(report, "floors", floor.between(0, 1) & (F.col("accuracy").isNull() | (F.abs(F.col("accuracy") - floor - margin) <= 1e-9)))


def close_to(value: float, expected: float, tolerance: float, what: str) -> float:
    if not abs(value - expected) <= tolerance:
        raise GateError(f"{what}: {value} is not within {tolerance} of {expected}")
    return value


def round_trips(rows: DataFrame, written: Column, original: str) -> DataFrame:
    """What is written reads back as what it was, on a table that is not empty."""
    if rows.isEmpty():
        raise GateError("nothing to check")
    return require(rows, "round trip", written.eqNullSafe(F.col(original)))


def known_values(rows: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    return require(rows, f"{column} outside its vocabulary", F.col(column).isin(list(allowed)))


def every_leaf_has_group(rows: DataFrame, group: Column) -> DataFrame:
    return require(rows, "leaves without a group", group.isNotNull())


def class_mix(rows: DataFrame, column: str, least_classes: int = 4, most_share: float = 0.6) -> DataFrame:
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    if counted[0] < least_classes or counted[1] > most_share * counted[2]:
        raise GateError(f"{counted[0]} classes, the largest with {counted[1]} of {counted[2]} rows")
    return rows


def rates_are(rows: DataFrame, expected: dict[str, float], tolerance: float = 0.05) -> DataFrame:
    """Realised shares of boolean columns lie within a tolerance of what was asked for."""
    found = rows.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in expected)).first()
    for c, x in expected.items():
        close_to(found[c] or 0.0, x, tolerance, f"rate of {c}")
    return rows


def no_cluster_lost(sample: DataFrame, full: DataFrame, cluster: str) -> DataFrame:
    return_to = full.select(cluster).distinct()
    contained(return_to, sample.select(cluster).distinct(), [cluster])
    return sample


def identical(a: DataFrame, b: DataFrame, key: str, value: str) -> dict[str, int]:
    """Compares two tables by key; raises unless every key is on both sides with the same value."""
    left, right = a.select(key, F.col(value).alias("_a"), F.lit(1).alias("_in_a")), b.select(key, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    both = left.join(right, key, "full_outer")
    shared = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    counts = both.agg(
        F.count(F.lit(1)).alias("n_compared"),
        F.count_if(shared & F.col("_a").eqNullSafe(F.col("_b"))).alias("n_equal"),
        F.count_if(F.col("_in_b").isNull()).alias("only_a"),
        F.count_if(F.col("_in_a").isNull()).alias("only_b"),
    ).first().asDict()
    if counts["n_equal"] != counts["n_compared"]:
        raise GateError(f"tables differ: {counts}")
    return counts
