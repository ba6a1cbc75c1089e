"""Two arms on the same items: pairing, flips, resampled intervals, jackknife, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from gaugeworks.functions.draws import AT_ONCE, uniform, uniforms
from gaugeworks.operators.ranges import place_within
from gaugeworks.operators.resampling import tree_bootstrap, written

#: Clusters of a cell whose means a task holds at most (32 MB), and that are sent as one row.
MOST_CLUSTERS, CHUNK = 4_000_000, 65_536


def pair_arms(control: DataFrame, arm: DataFrame, key: str = "qid", value: str = "correct") -> DataFrame:
    """Strict one-to-one pairing: raises unless both have the same, unique keys."""
    a = control.select(F.col(key), F.col(value).alias("correct_a"), F.lit(1).alias("in_a"))
    b = arm.select(F.col(key).alias("key_b"), F.col(value).alias("correct_b"), F.lit(1).alias("in_b"))
    both = a.join(b, F.col(key) == F.col("key_b"), "full_outer")
    alone = F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("alone")
    n_alone, n, n_keys = both.agg(alone, F.count(F.lit(1)), F.count_distinct(F.coalesce(key, "key_b"))).first()
    if n_alone:
        raise ValueError(f"{n_alone} items are in one arm only")
    if n != n_keys:
        raise ValueError(f"{n - n_keys} items are repeated in an arm")
    return both.select(key, "correct_a", "correct_b")


def flips(pairs: DataFrame, by: Sequence[str] = (), a: str = "correct_a", b: str = "correct_b") -> DataFrame:
    """n, fixed, broke, net, delta, flip_ratio (NULL if nothing was fixed), churn; NULL keys are kept."""
    fixed, broke = F.count_if(F.col(b) > F.col(a)), F.count_if(F.col(b) < F.col(a))
    done = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("acc_a"), F.avg(b).alias("acc_b"), fixed.alias("fixed"), broke.alias("broke"))
    return done.select(
        *by,
        "n",
        "acc_a",
        "acc_b",
        "fixed",
        "broke",
        (F.col("fixed") - F.col("broke")).alias("net"),
        ((F.col("fixed") - F.col("broke")) / F.col("n")).alias("delta"),
        F.try_divide(F.col("broke"), F.col("fixed")).alias("flip_ratio"),
        ((F.col("fixed") + F.col("broke")) / F.col("n")).alias("churn"),
    )


def grouped_delta(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, acc_a, acc_b, delta for each key, each rounded half-even to four places."""
    done = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("correct_a").alias("a"), F.avg("correct_b").alias("b"))
    return done.select(*by, "n", *(F.bround(x, 4).alias(n) for x, n in ((F.col("a"), "acc_a"), (F.col("b"), "acc_b"), (F.col("b") - F.col("a"), "delta"))))


def cluster_means(rows: DataFrame, by: Sequence[str], cluster: str, value: Column) -> DataFrame:
    """by, cluster, mean, n and a number from 0 for each cluster of its cell, in the order of its name; clusters of the cell.  Written once."""
    done = rows.groupBy(*by, cluster).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    for c in by:
        done = done.filter(F.col(c).isNotNull())
    numbered = place_within(done.filter("n > 0"), by, [cluster], "place").withColumn("number", F.col("place") - 1).drop("place")
    sizes = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("clusters"))
    return written(numbered.join(sizes, list(by)), "means")


def replicate_means(means: DataFrame, by: Sequence[str], draws: int, seed: int, total: int) -> DataFrame:
    """by, replicate, m: means of resampled clusters.  A cell's replicates are dealt to tasks by its share of all clusters, each with the cell's means as one array."""
    cores = means.sparkSession.sparkContext.defaultParallelism
    text = F.concat_ws("|", F.lit(str(seed)), F.lit("c"), *(F.col(c).cast("string") for c in by))
    parts = F.least(F.lit(draws), F.ceil(F.col("clusters") * F.lit(4 * cores / total))).cast("int")
    chunks = means.groupBy(*by, "clusters", F.floor(F.col("number") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("number", "mean"))).alias("held"))
    dealt = chunks.select(*by, "chunk", F.transform("held", lambda x: x["mean"]).alias("held"), text.alias("text"), parts.alias("parts"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition(4 * cores, *by, "part")

    def resampled(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.concatenate(pdf.sort_values("chunk")["held"].to_list())
        text, mine = pdf["text"].iloc[0], range(key[-1], draws, int(pdf["parts"].iloc[0]))
        m = [resampled_mean(f"{text}|{r}", held) for r in mine]
        return pd.DataFrame({**dict(zip(by, key, strict=False)), "replicate": np.array(mine, np.int32), "m": m})

    schema = StructType([*(means.schema[c] for c in by), StructField("replicate", IntegerType()), StructField("m", DoubleType())])
    return dealt.groupBy(*by, "part").applyInPandas(resampled, schema)


def resampled_mean(text: str, held: np.ndarray) -> float:
    """Mean of as many draws from ``held`` as it has values; slot i takes the value that the draw of ``text|i`` falls on."""
    n, total = len(held), 0.0
    for start in range(0, n, AT_ONCE):
        total += held[(uniforms(text, start, min(n, start + AT_ONCE)) * n).astype(np.int64)].sum()
    return total / n


def joined_replicates(means: DataFrame, by: Sequence[str], draws: int, seed: int) -> DataFrame:
    """The same by a join on (cell, number), with a row for each draw: for cells whose means are too many for one task."""
    slots = means.select(*by, F.col("number").alias("slot"), "clusters").repartition(means.sparkSession.sparkContext.defaultParallelism, *by, "slot")
    slots = slots.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = slots.withColumn("number", F.floor(uniform(seed, "c", *(F.col(c) for c in by), F.col("replicate"), F.col("slot")) * F.col("clusters")))
    picked = drawn.select(*by, "replicate", "number").join(means.select(*by, "number", "mean"), [*by, "number"])
    return picked.groupBy(*by, "replicate").agg(F.avg("mean").alias("m"))


def cluster_bootstrap(
    rows: DataFrame, by: Sequence[str], cluster: str, value: Column, draws: int = 200, seed: int = 0, level: float = 0.95, most: int = MOST_CLUSTERS
) -> DataFrame:
    """Point (mean of cluster means) and percentile interval from resampled clusters.

    Every replicate draws as many clusters as there are; how often cluster v is drawn
    comes from hashed draws, one for each slot, so draws are replicates x clusters, and the
    same on any cluster.  They are hashed and looked up within the tasks, and only a mean
    for each replicate leaves them; cells of more than ``most`` clusters are joined instead.
    """
    means = cluster_means(rows, by, cluster, value)
    largest, total = means.agg(F.max("clusters"), F.count(F.lit(1))).first()
    replicates = replicate_means(means.filter(F.col("clusters") <= most), by, draws, seed, max(total, 1))
    if largest and largest > most:
        replicates = replicates.unionByName(joined_replicates(means.filter(F.col("clusters") > most), by, draws, seed))
    tail = (1 - level) / 2
    ci = replicates.groupBy(*by).agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("ci"))
    point = means.groupBy(*by).agg(F.avg("mean").alias("point"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_clusters"))
    return point.join(ci, list(by)).select(*by, "n", "n_clusters", "point", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"))


def hierarchical_bootstrap(rows: DataFrame, by: Sequence[str], cluster: str, value: Column, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Two levels: clusters, then rows within each drawn cluster; point and percentile interval of the mean of means (``resampling``)."""
    return tree_bootstrap(rows, by, cluster, value, draws, seed, inner=True).drop("n")


def jackknife(rows: DataFrame, by: Sequence[str], cluster: str, value: Column) -> DataFrame:
    """Leave-one-cluster-out means in closed form: lo, hi, spread, worst cluster and its shift."""
    sums = rows.groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n")).filter("n > 0")
    totals = sums.groupBy(*by).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    left = sums.join(totals, list(by)).select(*by, cluster, (F.col("all_s") / F.col("all_n")).alias("mean"), F.try_divide(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")).alias("without"))
    worst = F.struct(F.abs(F.col("without") - F.col("mean")).alias("shift"), F.col(cluster).alias("cluster"))
    done = left.filter("without is not null").groupBy(*by).agg(
        F.max("mean").alias("mean"), F.count(F.lit(1)).alias("n_clusters"), F.min("without").alias("lo"), F.max("without").alias("hi"), F.max(worst).alias("w")
    )
    return done.select(*by, "mean", "n_clusters", "lo", "hi", (F.col("hi") - F.col("lo")).alias("spread"), F.col("w.cluster").alias("worst"), F.col("w.shift").alias("max_shift"))


def equivalence(low: Column, high: Column, epsilon: float) -> Column:
    """Where an interval lies against a margin of equivalence; strict on both sides."""
    if not epsilon > 0:
        raise ValueError("epsilon must be above 0")
    within, away = (low > -epsilon) & (high < epsilon), (low > 0) | (high < 0)
    named = F.when(within & away, "TRIVIAL_DIFFERENCE").when(within, "EQUIVALENT").when(away, "DIFFERENT").otherwise("INCONCLUSIVE")
    return F.when(low.isNull() | high.isNull(), "UNDEFINED").otherwise(named)


def arm_verdict(cells: DataFrame, granting: Sequence[str], cell: str = "cell", low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    """HARM if any cell lies below 0, else WIN if a granting cell lies above it, else NULL_RESULT."""
    harm = F.count_if(F.col(high) < 0)
    win = F.count_if(F.col(cell).isin(list(granting)) & (F.col(low) > 0))
    done = cells.agg(harm.alias("harmed"), win.alias("won"))
    return done.withColumn("verdict", F.when(F.col("harmed") > 0, "HARM").when(F.col("won") > 0, "WIN").otherwise("NULL_RESULT"))


def paired_verdict(cells: DataFrame, whole: str = "ALL", cell: str = "cell", least: float = 0.01) -> DataFrame:
    """One row: harmed (cells whose interval lies below zero, sorted), delta of the whole, verdict.

    HARM with any such cell; WIN if there is none, the whole's interval lies above zero and
    its delta is ``least`` or more; NULL_RESULT otherwise.  A cell without an interval
    neither harms nor grants.  ``cells``: cell, point, ci_low, ci_high.
    """
    of_whole = lambda c: F.max(F.when(F.col(cell) == whole, F.col(c)))
    told = cells.agg(F.array_sort(F.collect_set(F.when(F.col("ci_high") < 0, F.col(cell)))).alias("harmed"), of_whole("point").alias("delta"), of_whole("ci_low").alias("low"))
    granted = F.coalesce((F.col("low") > 0) & (F.abs("delta") >= least), F.lit(False))
    return told.select(F.array_join("harmed", ",").alias("harmed"), "delta", F.when(F.size("harmed") > 0, "HARM").when(granted, "WIN").otherwise("NULL_RESULT").alias("verdict"))


def policies(wide: DataFrame, key: str, gold: str, models: Sequence[str]) -> DataFrame:
    """policy, n, n_right, accuracy: each model alone, and the shorter answer of each two of them (of equal lengths that of the one named first).

    ``wide`` has a row for each key, with the gold and a column for each model; a missing
    answer is never right, and never the shorter one.
    """
    length = lambda m: F.coalesce(F.length(m), F.lit(1 << 30))
    told = [(m, F.col(m)) for m in models] + [(f"shorter_{a}_{b}", F.when(length(b) < length(a), F.col(b)).otherwise(F.col(a))) for k, a in enumerate(models) for b in models[k + 1 :]]
    each = wide.select(key, gold, F.inline(F.array(*(F.struct(F.lit(name).alias("policy"), answer.alias("answer")) for name, answer in told))))
    right = F.coalesce(F.col("answer") == F.col(gold), F.lit(False))
    return each.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("n_right"), F.avg(right.cast("double")).alias("accuracy"))


def within_cluster_delta(rows: DataFrame, cluster: str, score: str, flag: Column, least: int) -> DataFrame:
    """Mean score with and without the flag in every cluster that has ``least`` rows on both sides, and the delta."""
    yes, no = F.when(flag, F.col(score)), F.when(~flag, F.col(score))
    done = rows.groupBy(cluster).agg(F.count(yes).alias("n_yes"), F.count(no).alias("n_no"), F.avg(yes).alias("mean_yes"), F.avg(no).alias("mean_no"))
    return done.filter((F.col("n_yes") >= least) & (F.col("n_no") >= least)).withColumn("delta", F.col("mean_yes") - F.col("mean_no"))


def sign_test(k: Column, n: Column) -> Column:
    """Exact two-sided sign test of k successes in n: the binomial tail, doubled, one at most.

    Terms are built up from the first in logarithms, so no n underflows; the sum is a
    fold over an array of the smaller side.
    """
    low = F.least(k, n - k)
    first = n * F.log(F.lit(0.5))
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i)
        total = F.greatest(term, acc["total"]) + F.log1p(F.exp(-F.abs(term - acc["total"])))
        return F.struct(term.alias("term"), total.alias("total"))

    steps = F.when(low > 0, F.sequence(F.lit(1), low.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), F.exp(F.aggregate(steps, start, step, lambda acc: acc["total"] + F.log(F.lit(2.0)))))


def decide(clauses: Sequence[Column]) -> Column:
    """WIN if all clauses hold, NO-WIN if one doesn't, INDETERMINATE if one is unknown."""
    known, won = F.lit(True), F.lit(True)
    for clause in clauses:
        known, won = known & clause.isNotNull(), won & clause
    return F.when(~known, "INDETERMINATE").when(won, "WIN").otherwise("NO-WIN")


def halves(pairs: DataFrame, by: str) -> DataFrame:
    """half, n, delta: over all pairs, and over those of each value of ``by``."""
    each = F.explode(F.array(F.lit("ALL"), F.col(by)))
    rows = pairs.select(each.alias("half"), "correct_a", "correct_b")
    return rows.groupBy("half").agg(F.count(F.lit(1)).alias("n"), (F.avg("correct_b") - F.avg("correct_a")).alias("delta"))


def difference_in_differences(cells: DataFrame, key: str, tolerance: float, early: tuple[str, str], late: tuple[str, str]) -> DataFrame:
    """key, control, effect_a, effect_b, did, verdict from the early and late means of two corpora.

    control is GREEN where the early means agree within the tolerance; verdict says whether
    both corpora moved alike.  NULL where a mean is missing.
    """
    (a0, b0), (a1, b1) = early, late
    effect_a, effect_b = F.col(a1) - F.col(a0), F.col(b1) - F.col(b0)
    gap, did = F.abs(F.col(a0) - F.col(b0)), effect_a - effect_b
    control = F.when(gap <= tolerance, "GREEN").when(gap > tolerance, "RED")
    verdict = F.when(F.abs(did) <= tolerance, "SAME_EFFECT").when(F.abs(did) > tolerance, "NOT_SEPARABLE")
    return cells.select(key, control.alias("control"), effect_a.alias("effect_a"), effect_b.alias("effect_b"), did.alias("did"), verdict.alias("verdict"))


def run_liveness(log: DataFrame, run: str, order: Sequence[str], gradient: str, loss: str, ends: int = 10) -> DataFrame:
    """run, n_logged, moved (share of gradients above 0), first, last (mean loss of both ends); NULL values are no entries.

    Only the ends of each run are ranked, and a limit on ranks cuts each run before it is shuffled.
    """
    moved = log.groupBy(run).agg(F.count(gradient).alias("n_logged"), F.avg((F.col(gradient) > 0).cast("double")).alias("moved"))
    losses = log.filter(F.col(loss).isNotNull()).select(run, *order, loss)
    out = moved
    for name, by in (("first", [F.asc(c) for c in order]), ("last", [F.desc(c) for c in order])):
        ranked = losses.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(*by))).filter(F.col("place") <= ends)
        out = out.join(ranked.groupBy(run).agg(F.avg(loss).alias(name)), run, "left")
    return out


def argument_diff(a: DataFrame, b: DataFrame, key: str, value: str, allowed: Sequence[str]) -> DataFrame:
    """key, in_a, in_b, declared: arguments that differ, a missing one included; declared if their name has an allowed part."""
    both = a.select(key, F.col(value).alias("in_a"), F.lit(True).alias("has_a")).join(b.select(key, F.col(value).alias("in_b"), F.lit(True).alias("has_b")), key, "full_outer")
    differs = both.filter(F.col("has_a").isNull() | F.col("has_b").isNull() | ~F.col("in_a").eqNullSafe(F.col("in_b")))
    declared = F.lit(False)
    for part in allowed:
        declared = declared | F.contains(F.col(key), F.lit(part))
    return differs.select(key, "in_a", "in_b", declared.alias("declared"))
