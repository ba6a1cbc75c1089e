"""Cross-checks of answers with each other: stated counts, violations, sibling questions, cascades of rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violation_rates(rows: DataFrame, by: Sequence[str], tag: str, ok: str = "ok") -> DataFrame:
    """by, n, illegal rate, and the commonest violation with its count (first in order on ties)."""
    counted = rows.groupBy(*by, tag).agg(F.count(F.lit(1)).alias("n"))
    bad = F.when(F.col(tag) != ok, F.struct((-F.col("n")).alias("m"), F.col(tag).alias("tag")))
    done = counted.groupBy(*by).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col(tag) != ok, F.col("n"))), F.lit(0)).alias("illegal"), F.min(bad).alias("top"))
    return done.select(*by, "n", (F.col("illegal") / F.col("n")).alias("illegal_rate"), F.col("top.tag").alias("top_tag"), (-F.col("top.m")).alias("top_n"))


def regressions(rates: DataFrame, by: Sequence[str], arm: str, control: str, rate: str, least: float) -> DataFrame:
    """Arms whose rate exceeds the control's in the same cell by ``least`` or more, worst first."""
    base = rates.filter(F.col(arm) == control).select(*by, F.col(rate).alias("base"))
    return rates.filter(F.col(arm) != control).join(base, list(by)).withColumn("rise", F.col(rate) - F.col("base")).filter(F.col("rise") >= least).orderBy(F.desc("rise"), *by, arm)


def stated_agreement(rows: DataFrame, stated: str, listed: str) -> DataFrame:
    """Difference of the listed and the stated number, with counts."""
    return rows.groupBy((F.col(listed) - F.col(stated)).alias("delta")).agg(F.count(F.lit(1)).alias("n"))


def presence_scores(rows: DataFrame, by: Sequence[str], present: Column, said: Column) -> DataFrame:
    """Rate of saying yes where it is absent and where it is present, and the harmonic mean of being right on both."""
    yes = said.cast("double")
    done = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(present, yes)).alias("rate_present"), F.avg(F.when(~present, yes)).alias("rate_absent"))
    a, b = F.col("rate_present"), 1 - F.col("rate_absent")
    return done.withColumn("harmonic", F.coalesce(F.try_divide(2 * a * b, a + b), F.lit(0.0)))


def known_state_f1(rows: DataFrame, by: Sequence[str], state: str, said: Column) -> DataFrame:
    """Precision, recall and F1 over rows whose state is known; UNKNOWN rows count for neither side."""
    known = rows.filter(F.col(state).isin("PRESENT", "ABSENT"))
    yes = F.col(state) == "PRESENT"
    done = known.groupBy(*by).agg(F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return done.select(
        "*", F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1")
    )


def sibling_totals(rows: DataFrame, frame: str, part: Column, total: Column) -> DataFrame:
    """Frames that have parts and a total: their sum against the total, and whether it fits."""
    done = rows.groupBy(frame).agg(F.sum(part).alias("parts"), F.max(total).alias("total"))
    return done.filter("parts is not null and total is not null").withColumn("fits", F.col("parts") <= F.col("total"))


def first_match(rules: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """Name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, holds in reversed(list(rules)):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def modal_value(train: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """key, typical: the commonest value of each key (first in order on ties) with ``least`` rows or more."""
    counted = train.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    done = counted.groupBy(key).agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("top"))
    return done.filter(F.col("n") >= least).select(key, F.col("top.v").alias("typical"))


def order_quantiles(rows: DataFrame, by: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Order statistics: the value at place int(q n) of the sorted values, no interpolation."""
    w = Window.partitionBy(*by)
    placed = rows.filter(F.col(value).isNotNull()).select(*by, value, (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    at = [F.max(F.when(F.col("i") == F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1), F.col(value))).alias(f"q{int(q * 100)}") for q in qs]
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *at)


def long_counts(rows: DataFrame, keys: Sequence[str], total_by: str) -> DataFrame:
    """Counts by all keys, with the total of the first and the share in it."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy(total_by).agg(F.sum("n").alias("total"))
    return counted.join(total, total_by).withColumn("share", F.col("n") / F.col("total"))


def key_collisions(rows: DataFrame, space: str, key: str) -> DataFrame:
    """Distinct (space, key) pairs and distinct keys alone; a gap means that keys collide between spaces."""
    return rows.agg(F.count_distinct(space, key).alias("pairs"), F.count_distinct(key).alias("keys")).withColumn("collisions", F.col("pairs") - F.col("keys"))
