"""Scores by cell against the floor that a template-aware guesser reaches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def template_floor(rows: DataFrame, by: Sequence[str], answer: str = "answer", template: str = "template") -> DataFrame:
    """``by``, n, floor: the modal answers' share when every template answers with its mode.

    Rows without template or answer can't be guessed right, but stay in the denominator.
    Two nested aggregates with partial aggregation, over answers and then templates.
    """
    counted = rows.groupBy(*by, template, answer).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(template).isNotNull() & F.col(answer).isNotNull()
    best = counted.groupBy(*by, template).agg(F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("best"), F.sum("n").alias("n"))
    return best.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("best") / F.sum("n")).alias("floor"))


def cells(rows: DataFrame, by: Sequence[str], correct: str = "correct", answer: str = "answer", template: str = "template") -> DataFrame:
    """``by``, n, accuracy, floor, margin in one pass: correctness rides along in the floor's aggregates."""
    counted = rows.groupBy(*by, template, answer).agg(F.count(F.lit(1)).alias("n"), F.sum(correct).alias("right"), F.count(correct).alias("scored"))
    known = F.col(template).isNotNull() & F.col(answer).isNotNull()
    best = counted.groupBy(*by, template).agg(
        F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("best"), F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("scored").alias("scored")
    )
    done = best.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("scored")).alias("accuracy"), (F.sum("best") / F.sum("n")).alias("floor"))
    return done.withColumn("margin", F.col("accuracy") - F.col("floor"))


def stratified_report(rows: DataFrame, correct: str = "correct", min_n: int = 2) -> DataFrame:
    """The cells of every slice in one grouping: bucket (group x dist), bucket_format, format, dist and overall.

    slice, grp, fmt, dist, n, accuracy, floor, margin, in_mean (buckets of at least
    ``min_n`` rows, which the unweighted bucket mean is taken over).  An empty table
    gives an empty report.
    """
    sets = {"bucket": ("grp", "dist"), "bucket_format": ("grp", "fmt", "dist"), "format": ("fmt", "dist"), "dist": ("dist",), "overall": ()}
    wide = F.explode(
        F.array(
            *(
                F.struct(F.lit(name).alias("slice"), *((F.col(c) if c in keys else F.lit(None).cast("string")).alias(f"{c}_") for c in ("grp", "fmt", "dist")))
                for name, keys in sets.items()
            )
        )
    )
    # Counts first, so that the slices are expanded from templates and answers, not from rows.
    counted = rows.groupBy("grp", "fmt", "dist", "template", "answer").agg(F.count(F.lit(1)).alias("n"), F.sum(correct).alias("right"), F.count(correct).alias("scored"))
    spread = counted.withColumn("s", wide).select("s.*", "template", "answer", "n", "right", "scored")
    by = ["slice", "grp_", "fmt_", "dist_"]
    known = F.col("template").isNotNull() & F.col("answer").isNotNull()
    answers = spread.groupBy(*by, "template", "answer").agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("scored").alias("scored"))
    templates = answers.groupBy(*by, "template").agg(
        F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("best"), F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("scored").alias("scored")
    )
    done = templates.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("scored")).alias("accuracy"), (F.sum("best") / F.sum("n")).alias("floor"))
    return done.select(
        "slice",
        F.col("grp_").alias("grp"),
        F.col("fmt_").alias("fmt"),
        F.col("dist_").alias("dist"),
        "n",
        "accuracy",
        "floor",
        (F.col("accuracy") - F.col("floor")).alias("margin"),
        ((F.col("slice") == "bucket") & (F.col("n") >= min_n)).alias("in_mean"),
    )


def bucket_mean(report: DataFrame) -> DataFrame:
    """bucket_mean (unweighted), n_buckets, and the leaderboard proxy of a stratified report."""
    return report.agg(
        F.avg(F.when(F.col("in_mean"), F.col("accuracy"))).alias("bucket_mean"),
        F.count_if("in_mean").alias("n_buckets"),
        F.max(F.when(F.col("slice") == "overall", F.col("accuracy"))).alias("acc_overall"),
        F.max(F.when((F.col("slice") == "dist") & (F.col("dist") == "ID"), F.col("accuracy"))).alias("acc_id"),
        F.max(F.when((F.col("slice") == "dist") & (F.col("dist") == "OOD"), F.col("accuracy"))).alias("acc_ood"),
    )


def weighted_mean(rows: DataFrame, by: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """Mean of ``value`` weighted by ``weight``, rows without a value left out."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias(name))


def latency_report(rows: DataFrame, latency: str) -> DataFrame:
    """Mean, exact linear quantiles and maximum."""
    q = F.percentile(latency, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return rows.agg(F.count(latency).alias("n"), F.avg(latency).alias("mean"), q.alias("q"), F.max(latency).alias("max")).select(
        "n", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "max"
    )


def strata_gap(rows: DataFrame, by: Sequence[str], flag: str, correct: str = "correct", min_n: int = 10) -> DataFrame:
    """Margins with and without ``flag`` in every cell of at least ``min_n`` rows on both sides, and their gap."""
    done = cells(rows, [*by, flag], correct).filter(F.col("n") >= min_n)
    with_, without = F.when(F.col(flag), F.col("margin")), F.when(~F.col(flag), F.col("margin"))
    return done.groupBy(*by).agg(F.max(with_).alias("margin_with"), F.max(without).alias("margin_without")).withColumn("gap", F.col("margin_with") - F.col("margin_without"))


def coverage(rows: DataFrame, full: DataFrame, by: str) -> DataFrame:
    """Kept against full counts per value, with their share, and an ALL row."""
    kept, every = (t.groupBy(by).agg(F.count(F.lit(1)).alias(n)) for t, n in ((rows, "kept"), (full, "full")))
    both = every.join(kept, by, "full_outer").select(by, F.coalesce("full", F.lit(0)).alias("full"), F.coalesce("kept", F.lit(0)).alias("kept"))
    total = both.agg(F.lit("ALL").alias(by), F.sum("full").alias("full"), F.sum("kept").alias("kept"))
    return both.unionByName(total).withColumn("frac", F.try_divide(F.col("kept"), F.col("full")))


def share_drift(sample: DataFrame, full: DataFrame, by: str) -> DataFrame:
    """Share of each value in a sample and in the whole, and the difference."""

    def shares(rows: DataFrame, name: str) -> DataFrame:
        n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
        return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select(by, (F.col("n") / F.col("total")).alias(name))

    both = shares(full, "full_share").join(shares(sample, "sample_share"), by, "full_outer")
    return both.select(by, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("full_share", "sample_share"))).withColumn("drift", F.col("sample_share") - F.col("full_share"))


def entropy_bits(share: Column) -> Column:
    return F.sum(-share * F.log2(share))


def answer_profile(rows: DataFrame, by: Sequence[str], answer: str, correct: str) -> DataFrame:
    """Mode (lowest on ties), its share, accuracy on and off it, and the entropy of the answers in bits."""
    counted = rows.filter(F.col(answer).isNotNull()).groupBy(*by, answer).agg(F.count(F.lit(1)).alias("n"), F.sum(correct).alias("right"))
    total = counted.groupBy(*by).agg(F.sum("n").alias("total"), F.sum("right").alias("all_right"), F.max(F.struct("n", (-F.col(answer)).alias("m"), "right")).alias("top"))
    share = F.col("n") / F.col("total")
    h = counted.join(total, list(by)).groupBy(*by).agg(entropy_bits(share).alias("entropy")) if by else counted.crossJoin(F.broadcast(total)).agg(entropy_bits(share).alias("entropy"))
    joined = total.join(h, list(by)) if by else total.crossJoin(h)
    return joined.select(
        *by,
        "total",
        (-F.col("top.m")).alias("mode"),
        (F.col("top.n") / F.col("total")).alias("mode_share"),
        (F.col("top.right") / F.col("top.n")).alias("acc_on_mode"),
        F.try_divide(F.col("all_right") - F.col("top.right"), F.col("total") - F.col("top.n")).alias("acc_off_mode"),
        "entropy",
    )


def weight_for_share(share: Column, target: float) -> Column:
    """The weight that gives rows of a share the target share, all others weighing 1."""
    return F.try_divide(F.lit(target) * (1 - share), share * F.lit(1 - target))


def point_scores(points: Column, regions: Column) -> Column:
    """struct(n_points, n_inside, precision, n_covered, coverage) of points against boxes (x0, y0, x1, y1), edges included; NULL where a share has no whole."""
    within = lambda p, r: p["x"].between(r["x0"], r["x1"]) & p["y"].between(r["y0"], r["y1"])
    inside = F.size(F.filter(points, lambda p: F.exists(regions, lambda r: within(p, r))))
    covered = F.size(F.filter(regions, lambda r: F.exists(points, lambda p: within(p, r))))
    n = F.size(points)
    return F.struct(n.alias("n_points"), inside.alias("n_inside"), F.try_divide(inside, n).alias("precision"), covered.alias("n_covered"), F.try_divide(covered, F.size(regions)).alias("coverage"))


def point_report(rows: DataFrame, stratum: str) -> DataFrame:
    """A row for each stratum, none pooled: failures to parse apart, means over what parsed.

    ``rows`` has status and score (``point_scores``), count_status, count_correct and legal.
    """
    ok, counted = F.col("status") == "ok", F.col("count_status") == "ok"
    mean = lambda when, x: F.avg(F.when(when, x.cast("double")))
    return rows.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_point_parse_fail"),
        F.count_if(~F.coalesce(counted, F.lit(False))).alias("n_count_parse_fail"),
        mean(ok, F.col("score.n_points")).alias("mean_n_points"),
        mean(ok, F.col("score.precision")).alias("mean_precision"),
        mean(ok, F.col("score.coverage")).alias("mean_coverage"),
        mean(counted, F.col("count_correct")).alias("count_accuracy"),
        mean(counted, ~F.col("legal")).alias("illegal_rate"),
    )


def point_verdict(report: DataFrame, stratum: str, tolerance: float = 0.25) -> DataFrame:
    """verdict, spread: collapse where mean numbers of points hardly differ between strata above 0; inconclusive below two strata."""
    used = report.filter((F.col(stratum) > 0) & F.col("mean_n_points").isNotNull())
    done = used.agg(F.count(F.lit(1)).alias("n"), (F.max("mean_n_points") - F.min("mean_n_points")).alias("s"))
    return done.select(F.when(F.col("n") < 2, "inconclusive").when(F.col("s") < tolerance, "collapse").otherwise("individuates").alias("verdict"), F.when(F.col("n") >= 2, F.col("s")).alias("spread"))
