"""Multi-label sets, confusion and lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.ranges import running_totals


def class_counts(rows: DataFrame, by: Sequence[str] = (), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """by, class, tp, fp, fn, n_gold, n_pred; an unreadable (NULL) prediction misses every gold class."""
    empty = F.array().cast("array<string>")
    p, g = F.coalesce(F.col(pred), empty), F.coalesce(F.col(gold), empty)
    seen = rows.select(*by, p.alias("p"), g.alias("g")).withColumn("class", F.explode(F.array_union("g", "p")))
    in_gold, in_pred = F.array_contains("g", F.col("class")), F.array_contains("p", F.col("class"))
    return seen.groupBy(*by, "class").agg(
        F.count_if(in_gold & in_pred).alias("tp"),
        F.count_if(~in_gold & in_pred).alias("fp"),
        F.count_if(in_gold & ~in_pred).alias("fn"),
        F.count_if(in_gold).alias("n_gold"),
        F.count_if(in_pred).alias("n_pred"),
    )


def class_report(rows: DataFrame, by: Sequence[str] = (), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Counts with emission ratio, precision, recall and F1 (0 where nothing can be right)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return class_counts(rows, by, gold, pred).select(
        "*",
        F.try_divide(F.col("n_pred"), F.col("n_gold")).alias("emission"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
    )


def macro_f1(rows: DataFrame, by: Sequence[str] = (), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """macro_f1 over classes that occur in gold, exact_set_acc, n and n_illegal."""
    f1 = class_report(rows, by, gold, pred).filter("n_gold > 0").groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))
    same = F.coalesce(F.array_sort(gold) == F.array_sort(pred), F.lit(False))
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(pred).isNull()).alias("n_illegal"), F.avg(same.cast("double")).alias("exact_set_acc"))
    return whole.join(f1, list(by), "left") if by else whole.crossJoin(f1)


def error_taxonomy(rows: DataFrame, by: Sequence[str] = (), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Exact, strict subset, strict superset, swap (same size, one exchanged), disjoint, illegal and other sets."""
    g, p = F.col(gold), F.col(pred)
    missing, extra = F.size(F.array_except(g, p)), F.size(F.array_except(p, g))
    kind = (
        F.when(p.isNull(), "illegal")
        .when((missing == 0) & (extra == 0), "exact")
        .when(extra == 0, "subset")
        .when(missing == 0, "superset")
        .when((missing == 1) & (extra == 1), "swap")
        .when(F.size(F.array_intersect(g, p)) == 0, "disjoint")
        .otherwise("other")
    )
    return rows.withColumn("kind", kind).groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n"))


def set_recall_by_size(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Mean recall, containment and predicted size by the number of gold classes."""
    p = F.coalesce(F.col(pred), F.array().cast("array<string>"))
    hit = F.size(F.array_intersect(F.col(gold), p))
    n = F.size(gold)
    return rows.filter(n > 0).groupBy(n.alias("n_gold")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit / n).alias("recall"), F.avg((hit == n).cast("double")).alias("contained"), F.avg(F.size(p)).alias("mean_pred")
    )


def confusion(rows: DataFrame, by: Sequence[str], true: str, pred: str) -> DataFrame:
    """by, true, pred, n, p: share of each prediction among the rows of a true value."""
    counted = rows.groupBy(*by, true, pred).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by, true)))


def confusion_summary(rows: DataFrame, by: Sequence[str], true: str, pred: str, min_n: int = 30) -> DataFrame:
    """n, accuracy, whether the likeliest prediction differs for every true value, and whether rows are too few."""
    counted = rows.groupBy(*by, true, pred).agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy(*by, true).agg(F.max(F.struct("n", (-F.col(pred)).alias("m"))).alias("top"), F.sum("n").alias("n"), F.sum(F.when(F.col(true) == F.col(pred), F.col("n"))).alias("right"))
    done = top.groupBy(*by).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum("right"), F.lit(0)).alias("right"), F.count(F.lit(1)).alias("n_true"), F.count_distinct("top.m").alias("n_modes")
    )
    return done.select(*by, "n", (F.col("right") / F.col("n")).alias("accuracy"), (F.col("n_true") == F.col("n_modes")).alias("injective"), (F.col("n") < min_n).alias("underpowered"))


def lookup_table(rows: DataFrame, by: Sequence[str], pred: str, true: str) -> DataFrame:
    """by, pred, best: the likeliest true value behind each prediction, the lowest on ties."""
    counted = rows.groupBy(*by, pred, true).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by, pred).agg(F.max(F.struct("n", (-F.col(true)).alias("m"))).alias("top")).select(*by, pred, (-F.col("top.m")).alias("best"))


def lookup_gain(rows: DataFrame, by: Sequence[str], pred: str, true: str) -> DataFrame:
    """Accuracy before and after each prediction is replaced by the likeliest true value (in sample)."""
    counted = rows.groupBy(*by, pred, true).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(*by, pred).agg(F.max("n").alias("best"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col(pred) == F.col(true), F.col("n"))), F.lit(0)).alias("right"))
    done = best.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("acc"), (F.sum("best") / F.sum("n")).alias("acc_lut"))
    return done.withColumn("gain", F.col("acc_lut") - F.col("acc"))


def transfer_gain(fit: DataFrame, apply: DataFrame, by: Sequence[str], pred: str, true: str) -> DataFrame:
    """The table fitted on one set of rows, applied to another; unseen predictions count as wrong."""
    table = lookup_table(fit, by, pred, true)
    joined = apply.join(table, [*by, pred], "left")
    done = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(pred) == F.col(true)).cast("double")).alias("acc"),
        F.avg(F.coalesce(F.col("best") == F.col(true), F.lit(False)).cast("double")).alias("acc_lut"),
        F.count_if(F.col("best").isNull()).alias("n_unseen"),
    )
    return done.withColumn("gain", F.col("acc_lut") - F.col("acc"))


def concentration(rows: DataFrame, key: str, mass: Column) -> DataFrame:
    """key, mass, rank, cumulative mass, and whether the key belongs to the fewest that hold half of it."""
    sums = rows.groupBy(key).agg(F.sum(mass).alias("mass")).filter("mass > 0").withColumn("_one", F.lit(1).cast("long"))
    placed = running_totals(sums, ["-mass", key], {"rank": "_one", "running": "mass"}).drop("_one")
    total = placed.agg(F.sum("mass")).first()[0] or 0
    return placed.withColumn("total", F.lit(total)).withColumn("in_half", F.col("running") - F.col("mass") < F.col("total") / 2)


def counterfactual(rows: DataFrame, scenarios: dict[str, Column], correct: str) -> DataFrame:
    """Accuracy if the rows of each scenario were right: one pass, a column for each scenario."""
    base = F.avg(correct)
    fixed = {name: F.avg(F.when(cond, F.lit(1.0)).otherwise(F.col(correct))) for name, cond in scenarios.items()}
    wide = rows.agg(base.alias("base"), *(v.alias(k) for k, v in fixed.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.col(k).alias("accuracy"), (F.col(k) - F.col("base")).alias("headroom")) for k in scenarios)))
    return wide.select(pairs.alias("s")).select("s.*")


def route(rows: DataFrame, by: Sequence[str], a: str = "correct_a", b: str = "correct_b") -> DataFrame:
    """2x2 agreement of two arms in every cell, the better arm's mean, the oracle and its headroom."""
    one, two = F.col(a) == 1, F.col(b) == 1
    done = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(one & two).alias("both"),
        F.count_if(one & ~two).alias("only_a"),
        F.count_if(~one & two).alias("only_b"),
        F.count_if(~one & ~two).alias("neither"),
    )
    n = F.col("n")
    acc_a, acc_b = (F.col("both") + F.col("only_a")) / n, (F.col("both") + F.col("only_b")) / n
    return done.select(
        "*", F.when(acc_b > acc_a, "b").otherwise("a").alias("routed"), F.greatest(acc_a, acc_b).alias("routed_acc"), ((n - F.col("neither")) / n).alias("oracle"), ((n - F.col("neither")) / n - F.greatest(acc_a, acc_b)).alias("headroom")
    )
