"""Two arms over the same items."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import comparing
from gaugeworks.plans.rounding import rounded
from gaugeworks.registry import query
from gaugeworks.sources.adapters import ITEMS, SCORED, items, scored_documents

def delta():
    return F.col("correct_b") - F.col("correct_a")



def _flips(by: str) -> str:
    return f"""WITH {ITEMS}, f AS (SELECT {by}, count(*) AS n, avg(correct_a) AS acc_a, avg(correct_b) AS acc_b, count(*) FILTER (correct_b > correct_a) AS fixed,
        count(*) FILTER (correct_b < correct_a) AS broke FROM ev GROUP BY ALL)
        SELECT {by}, n, round(acc_a, 6) AS acc_a, round(acc_b, 6) AS acc_b, fixed, broke, fixed - broke AS net, round((fixed - broke) / n, 6) AS delta,
               round(broke / nullif(fixed, 0), 6) AS flip_ratio, round((fixed + broke) / n, 6) AS churn FROM f"""


FLIP_COLS = ("acc_a", "acc_b", "delta", "flip_ratio", "churn")


@query("agg16_flip_report", _flips("fmt, dist"))
def agg16(spark, sf_dir):
    return rounded(comparing.flips(items(spark, sf_dir), ["fmt", "dist"]), *FLIP_COLS)


@query("agg17_flips_by_video", _flips("video"))
def agg17(spark, sf_dir):
    return rounded(comparing.flips(items(spark, sf_dir), ["video"]), *FLIP_COLS)


@query("agg18_grouped_delta", f"WITH {ITEMS} SELECT grp, dist, count(*) AS n, round_even(avg(correct_a), 4) AS acc_a, round_even(avg(correct_b), 4) AS acc_b, round_even(avg(correct_b) - avg(correct_a), 4) AS delta FROM ev GROUP BY ALL")
def agg18(spark, sf_dir):
    return comparing.grouped_delta(items(spark, sf_dir), ["grp", "dist"])


@query("jon04_strict_pairs", f"WITH {ITEMS} SELECT dist, count(*) AS n, round(avg(correct_b - correct_a), 6) AS delta FROM ev GROUP BY dist")
def jon04(spark, sf_dir):
    rows = items(spark, sf_dir)
    pairs = comparing.pair_arms(rows.select("qid", F.col("correct_a").alias("correct")), rows.select("qid", F.col("correct_b").alias("correct")))
    done = pairs.join(rows.select("qid", "dist"), "qid").groupBy("dist").agg(F.count(F.lit(1)).alias("n"), F.avg(delta()).alias("delta"))
    return rounded(done, "delta")


def _bootstrap(value: str, draws: int, table: str = "ev") -> str:
    return f"""m AS (SELECT dist, video, avg({value}) AS mean, count({value}) AS n FROM {table} GROUP BY ALL),
        w AS (SELECT *, row_number() OVER (PARTITION BY dist ORDER BY video) - 1 AS number, count(*) OVER (PARTITION BY dist) AS clusters FROM m),
        s AS (SELECT dist, number AS slot, clusters, unnest(range({draws})) AS replicate FROM w),
        d AS (SELECT dist, replicate, floor(('0x' || substr(md5('0|c|' || dist || '|' || replicate || '|' || slot), 1, 8))::UBIGINT / 4294967296.0 * clusters)::INT AS number FROM s),
        r AS (SELECT d.dist, replicate, avg(mean) AS m FROM d JOIN w ON d.dist = w.dist AND d.number = w.number GROUP BY ALL),
        c AS (SELECT dist, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM r GROUP BY dist),
        p AS (SELECT dist, avg(mean) AS point, sum(n)::BIGINT AS n, count(*) AS n_clusters FROM w GROUP BY dist)"""


BOOT_SELECT = "SELECT dist, n, n_clusters, round(point, 6) AS point, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM p JOIN c USING (dist)"


@query("agg06_paired_cluster_bootstrap", f"WITH {ITEMS}, {_bootstrap('correct_b - correct_a', 2000)} {BOOT_SELECT}")
def agg06(spark, sf_dir):
    done = comparing.cluster_bootstrap(items(spark, sf_dir), ["dist"], "video", delta(), draws=2000)
    return rounded(done, "point", "ci_low", "ci_high")


@query("agg07_accuracy_bootstrap", f"WITH {ITEMS}, {_bootstrap('correct_a', 2000)} {BOOT_SELECT}")
def agg07(spark, sf_dir):
    return rounded(comparing.cluster_bootstrap(items(spark, sf_dir), ["dist"], "video", F.col("correct_a"), draws=2000), "point", "ci_low", "ci_high")


# 2,000 two-level draws are multinomial ones, which SQL does not have: tests hold both against a plain version.
@query("agg04_hierarchical_bootstrap")
def agg04(spark, sf_dir):
    return rounded(comparing.hierarchical_bootstrap(items(spark, sf_dir), ["dist"], "video", F.col("correct_a")), "point", "ci_low", "ci_high")


@query("agg05_paired_delta")
def agg05(spark, sf_dir):
    rows = items(spark, sf_dir)
    wins = rows.groupBy("dist").agg(F.count_if(delta() > 0).alias("wins_b"), F.count_if(delta() < 0).alias("wins_a"), F.count(F.lit(1)).alias("n"))
    done = comparing.hierarchical_bootstrap(rows, ["dist"], "video", delta()).join(wins, "dist")
    return rounded(done, "point", "ci_low", "ci_high")


@query("agg12_jackknife", f"""WITH {ITEMS}, s AS (SELECT dist, video, sum(correct_a) AS s, count(*) AS n FROM ev GROUP BY ALL),
    l AS (SELECT dist, video, sum(s) OVER w / sum(n) OVER w AS mean, (sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0) AS without FROM s WINDOW w AS (PARTITION BY dist)),
    m AS (SELECT dist, video, mean, without, row_number() OVER (PARTITION BY dist ORDER BY round(abs(without - mean), 12) DESC, video DESC) AS rn FROM l WHERE without IS NOT NULL)
    SELECT dist, round(max(mean), 6) AS mean, count(*) AS n_clusters, round(min(without), 6) AS lo, round(max(without), 6) AS hi, round(max(without) - min(without), 6) AS spread,
           round(max(abs(without - mean)), 6) AS max_shift FROM m GROUP BY dist""")
def agg12(spark, sf_dir):
    return rounded(comparing.jackknife(items(spark, sf_dir), ["dist"], "video", F.col("correct_a")).drop("worst"), "mean", "lo", "hi", "spread", "max_shift")


@query("agg14_jackknife_wins", f"""WITH {ITEMS}, s AS (SELECT dist, video, sum(correct_b - correct_a) AS s, count(*) AS n FROM ev GROUP BY ALL),
    l AS (SELECT dist, (sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0) AS d FROM s WINDOW w AS (PARTITION BY dist))
    SELECT dist, count(*) AS n_clusters, count(*) FILTER (d > 0) AS wins, round(min(d), 6) AS min_delta, round(max(d), 6) AS max_delta FROM l GROUP BY dist""")
def agg14(spark, sf_dir):
    sums = items(spark, sf_dir).groupBy("dist", "video").agg(F.sum(delta()).alias("s"), F.count(F.lit(1)).alias("n"))
    totals = sums.groupBy("dist").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    d = F.try_divide(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n"))
    done = sums.join(totals, "dist").withColumn("d", d).groupBy("dist").agg(
        F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("d") > 0).alias("wins"), F.min("d").alias("min_delta"), F.max("d").alias("max_delta")
    )
    return rounded(done, "min_delta", "max_delta")


@query("add01_equivalence", f"""WITH {ITEMS}, {_bootstrap('correct_b - correct_a', 2000)}
    SELECT dist, CASE WHEN ci_low > -0.1 AND ci_high < 0.1 THEN CASE WHEN ci_low > 0 OR ci_high < 0 THEN 'TRIVIAL_DIFFERENCE' ELSE 'EQUIVALENT' END
                      WHEN ci_low > 0 OR ci_high < 0 THEN 'DIFFERENT' ELSE 'INCONCLUSIVE' END AS verdict,
           round(greatest(abs(ci_low), abs(ci_high)), 6) AS epsilon_min FROM c""")
def add01(spark, sf_dir):
    ci = comparing.cluster_bootstrap(items(spark, sf_dir), ["dist"], "video", delta(), draws=2000)
    done = ci.select("dist", comparing.equivalence(F.col("ci_low"), F.col("ci_high"), 0.1).alias("verdict"), F.greatest(F.abs("ci_low"), F.abs("ci_high")).alias("epsilon_min"))
    return rounded(done, "epsilon_min")


@query("add05_arm_verdict", f"""WITH {ITEMS}, {_bootstrap('correct_b - correct_a', 2000)}, v AS (SELECT count(*) FILTER (ci_high < 0) AS harmed, count(*) FILTER (dist = 'ID' AND ci_low > 0) AS won FROM c)
    SELECT harmed, won, CASE WHEN harmed > 0 THEN 'HARM' WHEN won > 0 THEN 'WIN' ELSE 'NULL_RESULT' END AS verdict FROM v""")
def add05(spark, sf_dir):
    ci = comparing.cluster_bootstrap(items(spark, sf_dir), ["dist"], "video", delta(), draws=2000)
    return comparing.arm_verdict(ci.withColumnRenamed("dist", "cell"), ["ID"])


@query("agg08_within_cluster_delta", f"""WITH {SCORED}, c AS (SELECT source, count(*) FILTER (quality = 1) AS n_yes, count(*) FILTER (quality = 0) AS n_no, avg(score) FILTER (quality = 1) AS mean_yes,
    avg(score) FILTER (quality = 0) AS mean_no FROM dl GROUP BY source)
    SELECT source, n_yes, n_no, round(mean_yes, 6) AS mean_yes, round(mean_no, 6) AS mean_no, round(mean_yes - mean_no, 6) AS delta FROM c WHERE n_yes >= 2 AND n_no >= 2""")
def agg08(spark, sf_dir):
    done = comparing.within_cluster_delta(scored_documents(spark, sf_dir), "source", "score", F.col("quality") == 1, 2)
    return rounded(done, "mean_yes", "mean_no", "delta")


@query("agg48_sign_test", f"""WITH {ITEMS}, c AS (SELECT grp, video, avg(correct_b - correct_a) AS d FROM ev GROUP BY ALL), s AS (SELECT grp, count(*) FILTER (d > 0) AS k, count(*) FILTER (d <> 0) AS n FROM c GROUP BY grp),
    t AS (SELECT grp, k, n, unnest(range(0, least(k, n - k) + 1)) AS i FROM s)
    SELECT grp, k, n, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 6) AS p FROM t GROUP BY grp, k, n""")
def agg48(spark, sf_dir):
    per = items(spark, sf_dir).groupBy("grp", "video").agg(F.avg(delta()).alias("d"))
    done = per.groupBy("grp").agg(F.count_if(F.col("d") > 0).alias("k"), F.count_if(F.col("d") != 0).alias("n"))
    return rounded(done.select("grp", "k", "n", comparing.sign_test(F.col("k"), F.col("n")).alias("p")), "p")


@query("agg10_interaction", f"""WITH {ITEMS}, m AS (SELECT k % 2 = 0 AS typical, video, avg(correct_b - correct_a) AS d FROM ev GROUP BY ALL), a AS (SELECT typical, avg(d) AS d, count(*) AS n FROM m GROUP BY typical)
    SELECT round(max(d) FILTER (typical), 6) AS typical, round(max(d) FILTER (NOT typical), 6) AS atypical, round(max(d) FILTER (NOT typical) - max(d) FILTER (typical), 6) AS interaction FROM a""")
def agg10(spark, sf_dir):
    side = F.col("k") % 2 == 0
    means = items(spark, sf_dir).groupBy(side.alias("typical"), "video").agg(F.avg(delta()).alias("d")).groupBy("typical").agg(F.avg("d").alias("d"))
    done = means.agg(F.max(F.when(F.col("typical"), F.col("d"))).alias("typical"), F.max(F.when(~F.col("typical"), F.col("d"))).alias("atypical"))
    return rounded(done.withColumn("interaction", F.col("atypical") - F.col("typical")), "typical", "atypical", "interaction")
