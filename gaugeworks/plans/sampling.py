"""Samples, splits and quotas over items and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.draws import pick, uniform
from gaugeworks.operators import gates, sampling
from gaugeworks.plans.rounding import rounded
from gaugeworks.registry import query
from gaugeworks.sources.adapters import ITEMS, items, read


@query("smp01_stratified", f"""WITH {ITEMS}, s AS (SELECT qid, grp, fmt, row_number() OVER (PARTITION BY grp, fmt ORDER BY md5('0|s|' || qid), qid) AS p, greatest(round_even(count(*) OVER (PARTITION BY grp, fmt) * 0.1::DOUBLE, 0), 1) AS q FROM ev)
    SELECT qid, grp, fmt FROM s WHERE p <= q""")
def smp01(spark, sf_dir):
    return sampling.stratified(items(spark, sf_dir).select("qid", "grp", "fmt"), ["grp", "fmt"], "qid", 0.1)


@query("smp24_sample_gate", f"""WITH {ITEMS}, s AS (SELECT qid, video, row_number() OVER (PARTITION BY video ORDER BY md5('0|s|' || qid), qid) AS p, greatest(round_even(count(*) OVER (PARTITION BY video) * 0.05::DOUBLE, 0), 1) AS q FROM ev)
    SELECT count(*) AS n, count(DISTINCT video) AS n_videos FROM s WHERE p <= q""")
def smp24(spark, sf_dir):
    rows = items(spark, sf_dir).select("qid", "video")
    sample = gates.no_cluster_lost(sampling.stratified(rows, ["video"], "qid", 0.05), rows, "video")
    return sample.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("video").alias("n_videos"))


@query("smp08_equal_per_cell", f"WITH {ITEMS}, s AS (SELECT qid, fmt, dist, row_number() OVER (PARTITION BY fmt, dist ORDER BY md5('4|e|' || qid), qid) AS p FROM ev) SELECT qid, fmt, dist FROM s WHERE p <= 5")
def smp08(spark, sf_dir):
    return sampling.equal_per_cell(items(spark, sf_dir).select("qid", "fmt", "dist"), ["fmt", "dist"], "qid", 5, seed=4)


@query("smp15_round_robin", f"""WITH {ITEMS}, s AS (SELECT qid, video, row_number() OVER (PARTITION BY video ORDER BY md5('0|r|' || qid), qid) AS turn FROM ev) SELECT qid, video FROM s ORDER BY turn, md5('0|g|' || video), video LIMIT 40""")
def smp15(spark, sf_dir):
    return sampling.round_robin(items(spark, sf_dir).select("qid", "video"), "video", "qid", 40)


@query("smp07_largest_remainder", """WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), e AS (SELECT source, n, n * 100.0::DOUBLE / sum(n) OVER () AS x FROM s), f AS (SELECT *, floor(x)::BIGINT AS fl, x - floor(x) AS rest FROM e),
    p AS (SELECT *, row_number() OVER (ORDER BY rest DESC, n DESC, source) AS place, 100 - sum(fl) OVER () AS lft FROM f) SELECT source, n, least(fl + (place <= lft)::INT, n) AS quota FROM p""")
def smp07(spark, sf_dir):
    sizes = read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sampling.largest_remainder(sizes, "source", "n", 100)


@query("win08_cluster_split", f"""WITH {ITEMS}, c AS (SELECT DISTINCT grp, video FROM ev), p AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY md5('42|v|' || video), video) AS place FROM c)
    SELECT grp, video, CASE WHEN place <= CASE WHEN n = 1 THEN 0 ELSE greatest(1, round_even(n * 0.2::DOUBLE, 0)) END THEN 'val_id' ELSE 'train' END AS split FROM p""")
def win08(spark, sf_dir):
    return sampling.cluster_split(items(spark, sf_dir), "grp", "video", 0.2, seed=42)


@query("smp05_leave_one_out", f"WITH {ITEMS}, s AS (SELECT grp, count(*) AS n FROM ev GROUP BY grp) SELECT a.grp AS fold, b.grp, CASE WHEN a.grp = b.grp THEN 'val' ELSE 'train' END AS split, b.n FROM s a, s b")
def smp05(spark, sf_dir):
    return sampling.leave_one_out_folds(items(spark, sf_dir), "grp")


@query("smp18_cap_per_bucket", f"WITH {ITEMS}, s AS (SELECT qid, answer, dist, row_number() OVER (PARTITION BY dist, answer ORDER BY md5('0|k|' || qid), qid) AS p FROM ev) SELECT qid, answer, dist FROM s WHERE p <= CASE WHEN dist = 'ID' THEN 20 ELSE 5 END")
def smp18(spark, sf_dir):
    cap = F.when(F.col("dist") == "ID", 20).otherwise(5)
    return sampling.cap_per_bucket(items(spark, sf_dir).select("qid", "answer", "dist"), ["dist", "answer"], "qid", cap)


@query("top08_weighted_sample", f"WITH {ITEMS}, s AS (SELECT qid, pow(('0x' || substr(md5('9|w|' || qid), 1, 8))::UBIGINT / 4294967296.0, 1.0 / (1 + k % 7)) AS u FROM ev) SELECT qid FROM s ORDER BY u DESC, qid LIMIT 50")
def top08(spark, sf_dir):
    return sampling.weighted_sample(items(spark, sf_dir).select("qid", "k"), "qid", 1 + F.col("k") % 7, 50, seed=9).select("qid")


@query("smp13_shuffle_donors", f"""WITH {ITEMS}, p AS (SELECT qid, row_number() OVER (ORDER BY video, qid) - 1 AS at FROM ev), g AS (SELECT max(c) AS shift, sum(c) AS n FROM (SELECT count(*) AS c FROM ev GROUP BY video))
    SELECT a.qid, b.qid AS donor FROM p a, g, p b WHERE b.at = (a.at + g.shift) % g.n""")
def smp13(spark, sf_dir):
    return sampling.shuffle_donors(items(spark, sf_dir), "video", "qid")


@query("smp09_unit_draws", f"WITH {ITEMS} SELECT grp, count(*) AS n, round(avg(('0x' || substr(md5('5|unit|' || qid), 1, 8))::UBIGINT / 4294967296.0), 6) AS mean_u, count(*) FILTER (('0x' || substr(md5('5|unit|' || qid), 1, 8))::UBIGINT / 4294967296.0 < 0.25) AS low FROM ev GROUP BY grp")
def smp09(spark, sf_dir):
    u = uniform(5, "unit", F.col("qid"))
    return rounded(items(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg(u).alias("mean_u"), F.count_if(u < 0.25).alias("low")), "mean_u")


@query("smp11_categorical_draws", f"WITH {ITEMS}, d AS (SELECT ['none', 'blur', 'shift', 'crop'][floor(('0x' || substr(md5('11|op|' || qid), 1, 8))::UBIGINT / 4294967296.0 * 4)::INT + 1] AS op FROM ev) SELECT op, count(*) AS n, round(count(*) / (SELECT count(*) FROM d), 6) AS share FROM d GROUP BY op")
def smp11(spark, sf_dir):
    op = pick(F.array(*(F.lit(x) for x in ("none", "blur", "shift", "crop"))), uniform(11, "op", F.col("qid")))
    counted = items(spark, sf_dir).groupBy(op.alias("op")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return rounded(counted.crossJoin(F.broadcast(total)).select("op", "n", (F.col("n") / F.col("total")).alias("share")), "share")
