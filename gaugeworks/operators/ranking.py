"""Average ranks and what is built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.ranges import running_totals
from gaugeworks.sources import folders

#: Distinct values of a cell that one window orders at most.
WINDOW_VALUES = 1_000_000


def counts_upto(counted: DataFrame, by: Sequence[str], value: str, n: str, name: str, most: int = WINDOW_VALUES) -> DataFrame:
    """``counted`` (a row for each value of a cell) with the rows of the cell up to and with the value.

    In a window as long as no cell has more than ``most`` values, else by ranges of all of them.
    """
    path = folders.fresh_path(counted.sparkSession, "values")
    counted.write.parquet(path)
    counted = counted.sparkSession.read.schema(counted.schema).parquet(path)
    if (counted.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= most:
        return counted.withColumn(name, F.sum(n).over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    summed = running_totals(counted, [*by, value], {"_upto": n})
    starts = summed.groupBy(*by).agg(F.min(F.col("_upto") - F.col(n)).alias("_start"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    return summed.alias("s").join(starts.alias("t"), same).select(*(F.col(f"s.{c}") for c in counted.columns), (F.col("_upto") - F.col("_start")).alias(name))


def value_ranks(rows: DataFrame, by: Sequence[str], value: str, weights: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """by, value, n, rank: average rank of every distinct value, with summed ``weights``.

    Ranks come from running counts over distinct values, so windows see grouped rows only.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(name) for name, c in weights))
    return counts_upto(counted, by, value, "n", "upto").withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2).drop("upto")


def spearman(rows: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Pearson correlation of average ranks; NULL for fewer than ``least`` pairs or a constant side."""
    pairs = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("pairs"))
    expanded = [F.col("pairs")]
    rx = pairs.groupBy(*by, x).agg(F.sum("pairs").alias("nx"))
    ry = pairs.groupBy(*by, y).agg(F.sum("pairs").alias("ny"))
    rank_x = counts_upto(rx, by, x, "nx", "upto").select(*by, x, (F.col("upto") - (F.col("nx") - 1) / 2).alias("rx"))
    rank_y = counts_upto(ry, by, y, "ny", "upto").select(*by, y, (F.col("upto") - (F.col("ny") - 1) / 2).alias("ry"))
    joined = pairs.join(rank_x, [*by, x]).join(rank_y, [*by, y])
    w, a, b = expanded[0], F.col("rx"), F.col("ry")
    sums = joined.groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab")
    )
    n = F.col("n")
    va, vb = n * F.col("saa") - F.col("sa") ** 2, n * F.col("sbb") - F.col("sb") ** 2
    r = (n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(va) / F.sqrt(vb)
    return sums.select(*by, "n", F.when((n >= least) & (va > 0) & (vb > 0), r).alias("spearman"))


def auc(rows: DataFrame, by: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Mann-Whitney AUC by average ranks; NULL if a side is empty."""
    ranked = value_ranks(rows, by, score, [("pos", positive.cast("int"))])
    done = ranked.groupBy(*by).agg(F.sum("pos").alias("n_pos"), (F.sum("n") - F.sum("pos")).alias("n_neg"), F.sum(F.col("rank") * F.col("pos")).alias("rank_sum"))
    n1, n0 = F.col("n_pos"), F.col("n_neg")
    return done.select(*by, "n_pos", "n_neg", F.try_divide(F.col("rank_sum") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def point_biserial(rows: DataFrame, by: Sequence[str], score: str, flag: Column) -> DataFrame:
    """Pearson correlation of a score and a flag; NULL if either is constant."""
    f = flag.cast("double")
    done = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(score).alias("s"), F.stddev_pop(f).alias("t"), F.covar_pop(f, F.col(score)).alias("c"))
    return done.select(*by, "n", F.try_divide(F.col("c"), F.col("s") * F.col("t")).alias("r"))


def rank_deciles(rows: DataFrame, by: Sequence[str], value: str, flag: Column) -> DataFrame:
    """Share of flagged rows by decile of the average rank over n: min(floor(10 q) + 1, 10)."""
    ranked = value_ranks(rows, by, value, [("flagged", flag.cast("int"))])
    total = F.sum("n").over(Window.partitionBy(*by))
    q = F.col("rank") / total
    done = ranked.withColumn("decile", F.least(F.floor(q * 10).cast("int") + 1, F.lit(10)))
    return done.groupBy(*by, "decile").agg(F.sum("n").alias("n"), (F.sum("flagged") / F.sum("n")).alias("rate"))


def separability(rows: DataFrame, by: Sequence[str], scores: Sequence[str], positive: Column, cluster: str, min_rows: int, min_clusters: int) -> DataFrame:
    """AUC of every score in every cell with enough rows and clusters on each side."""
    wide = rows.select(*by, cluster, positive.alias("positive"), *scores)
    long = wide.select(*by, cluster, "positive", F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("x")) for s in scores))).alias("e")).select(*by, cluster, "positive", "e.*")
    sides = long.groupBy(*by, "score").agg(
        F.count_if("positive").alias("p"),
        F.count_if(~F.col("positive")).alias("q"),
        F.count_distinct(F.when(F.col("positive"), F.col(cluster))).alias("cp"),
        F.count_distinct(F.when(~F.col("positive"), F.col(cluster))).alias("cq"),
    )
    usable = sides.filter((F.least("p", "q") >= min_rows) & (F.least("cp", "cq") >= min_clusters)).select(*by, "score")
    return auc(long, [*by, "score"], "x", F.col("positive")).join(usable, [*by, "score"], "left_semi")
