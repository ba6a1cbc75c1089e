"""Rank statistics over items and labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import ranking
from gaugeworks.plans.rounding import rounded
from gaugeworks.registry import query
from gaugeworks.sources.adapters import ITEMS, SCORED, items, scored_documents


@query("agg20_spearman", f"""WITH {ITEMS}, r AS (SELECT dist, rank() OVER (PARTITION BY dist ORDER BY pred) + (count(*) OVER (PARTITION BY dist, pred) - 1) / 2 AS a, rank() OVER (PARTITION BY dist ORDER BY answer) + (count(*) OVER (PARTITION BY dist, answer) - 1) / 2 AS b FROM ev)
    SELECT dist, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY dist""")
def agg20(spark, sf_dir):
    return rounded(ranking.spearman(items(spark, sf_dir), ["dist"], "pred", "answer"), "spearman")


@query("agg19_count_rank", f"""WITH {ITEMS}, f AS (SELECT * FROM ev WHERE fmt = 'number'), r AS (SELECT dist, pred, answer, rank() OVER (PARTITION BY dist ORDER BY pred) + (count(*) OVER (PARTITION BY dist, pred) - 1) / 2 AS a, rank() OVER (PARTITION BY dist ORDER BY answer) + (count(*) OVER (PARTITION BY dist, answer) - 1) / 2 AS b FROM f)
    SELECT dist, count(*) AS n, round(corr(a, b), 6) AS spearman, round(avg(pred), 6) AS mean_pred, round(avg(answer), 6) AS mean_gold, round(avg(pred - answer), 6) AS bias, round(avg((pred = answer)::INT), 6) AS exact FROM r GROUP BY dist""")
def agg19(spark, sf_dir):
    rows = items(spark, sf_dir).filter("fmt = 'number'")
    means = rows.groupBy("dist").agg(
        F.avg("pred").alias("mean_pred"), F.avg("answer").alias("mean_gold"), F.avg(F.col("pred") - F.col("answer")).alias("bias"), F.avg((F.col("pred") == F.col("answer")).cast("double")).alias("exact")
    )
    return rounded(ranking.spearman(rows, ["dist"], "pred", "answer").join(means, "dist"), "spearman", "mean_pred", "mean_gold", "bias", "exact")


@query("agg21_correlate", f"WITH {ITEMS} SELECT answer, count(*) AS n, round(avg(pred), 6) AS mean_pred, round(avg(abs(pred - answer)), 6) AS mae, round(avg((pred = 0)::INT), 6) AS zero_rate, count(DISTINCT video) AS n_videos FROM ev GROUP BY answer")
def agg21(spark, sf_dir):
    done = items(spark, sf_dir).groupBy("answer").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pred").alias("mean_pred"), F.avg(F.abs(F.col("pred") - F.col("answer"))).alias("mae"), F.avg((F.col("pred") == 0).cast("double")).alias("zero_rate"), F.count_distinct("video").alias("n_videos")
    )
    return rounded(done, "mean_pred", "mae", "zero_rate")


@query("agg22_spearman_pairs", f"""WITH {ITEMS}, r AS (SELECT video, rank() OVER (PARTITION BY video ORDER BY pred) + (count(*) OVER (PARTITION BY video, pred) - 1) / 2 AS a, rank() OVER (PARTITION BY video ORDER BY answer) + (count(*) OVER (PARTITION BY video, answer) - 1) / 2 AS b FROM ev)
    SELECT video, count(*) AS n, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS spearman FROM r GROUP BY video""")
def agg22(spark, sf_dir):
    return rounded(ranking.spearman(items(spark, sf_dir), ["video"], "pred", "answer", least=2), "spearman")


@query("agg44_auc", f"""WITH {SCORED}, r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS k FROM dl),
    s AS (SELECT lang, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality <> 1) AS n_neg, sum(k) FILTER (quality = 1) AS s FROM r GROUP BY lang)
    SELECT lang, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2) / nullif(n_pos * n_neg, 0), 6) AS auc FROM s""")
def agg44(spark, sf_dir):
    return rounded(ranking.auc(scored_documents(spark, sf_dir), ["lang"], "score", F.col("quality") == 1), "auc")


@query("agg09_point_biserial", f"WITH {SCORED} SELECT lang, count(*) AS n, round(corr(quality, score), 6) AS r FROM dl GROUP BY lang")
def agg09(spark, sf_dir):
    return rounded(ranking.point_biserial(scored_documents(spark, sf_dir), ["lang"], "score", F.col("quality") == 1), "r")


@query("win03_rank_deciles", f"""WITH {ITEMS}, r AS (SELECT grp, correct_a, (rank() OVER (PARTITION BY grp ORDER BY t) + (count(*) OVER (PARTITION BY grp, t) - 1) / 2) / count(*) OVER (PARTITION BY grp) AS q FROM ev)
    SELECT grp, least(floor(q * 10)::INT + 1, 10) AS decile, count(*) AS n, round(avg((correct_a = 0)::INT), 6) AS rate FROM r GROUP BY ALL""")
def win03(spark, sf_dir):
    return rounded(ranking.rank_deciles(items(spark, sf_dir), ["grp"], "t", F.col("correct_a") == 0), "rate")


@query("agg45_separability", f"""WITH {SCORED}, l AS (SELECT lang, source, quality = 1 AS p, 'score' AS name, score AS x FROM dl UNION ALL SELECT lang, source, quality = 1, 'digit', (doc_id % 10)::DOUBLE FROM dl),
    u AS (SELECT lang, name FROM l GROUP BY ALL HAVING least(count(*) FILTER (p), count(*) FILTER (NOT p)) >= 5 AND least(count(DISTINCT source) FILTER (p), count(DISTINCT source) FILTER (NOT p)) >= 3),
    r AS (SELECT lang, name, p, rank() OVER (PARTITION BY lang, name ORDER BY x) + (count(*) OVER (PARTITION BY lang, name, x) - 1) / 2 AS k FROM l),
    s AS (SELECT lang, name, count(*) FILTER (p) AS n_pos, count(*) FILTER (NOT p) AS n_neg, sum(k) FILTER (p) AS s FROM r GROUP BY ALL)
    SELECT lang, name AS score, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) AS auc FROM s JOIN u USING (lang, name)""")
def agg45(spark, sf_dir):
    rows = scored_documents(spark, sf_dir).withColumn("digit", (F.col("doc_id") % 10).cast("double"))
    return rounded(ranking.separability(rows, ["lang"], ["score", "digit"], F.col("quality") == 1, "source", 5, 3), "auc")


@query("agg46_within_cluster_auc", f"""WITH {SCORED}, r AS (SELECT source, quality, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2 AS k FROM dl),
    s AS (SELECT source, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS q, sum(k) FILTER (quality = 1) AS s FROM r GROUP BY source)
    SELECT count(*) AS cells, count(*) FILTER (a > 0.5) AS wins, round(avg(a), 6) AS mean_auc FROM (SELECT (s - p * (p + 1) / 2) / (p * q) AS a FROM s WHERE p >= 2 AND q >= 2)""")
def agg46(spark, sf_dir):
    per = ranking.auc(scored_documents(spark, sf_dir), ["source"], "score", F.col("quality") == 1).filter("n_pos >= 2 and n_neg >= 2")
    return rounded(per.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("auc") > 0.5).alias("wins"), F.avg("auc").alias("mean_auc")), "mean_auc")


@query("agg43_rate_against_chance", f"""WITH {ITEMS}, c AS (SELECT 2 + k % 4 AS n_cands, correct_a, 1.0::DOUBLE / (2 + k % 4) AS chance FROM ev) SELECT n_cands, count(*) AS n, round(avg(correct_a), 6) AS observed, round(avg(chance), 6) AS chance, round(avg(correct_a - chance), 6) AS lift FROM c GROUP BY n_cands""")
def agg43(spark, sf_dir):
    n = 2 + F.col("k") % 4
    rows = items(spark, sf_dir).select(n.alias("n_cands"), "correct_a", (F.lit(1.0) / n).alias("p"))
    done = rows.groupBy("n_cands").agg(F.count(F.lit(1)).alias("n"), F.avg("correct_a").alias("observed"), F.avg("p").alias("chance"), F.avg(F.col("correct_a") - F.col("p")).alias("lift"))
    return rounded(done, "observed", "chance", "lift")
