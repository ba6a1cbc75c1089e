"""Scores, floors and reports over items."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.draws import uniform
from gaugeworks.operators import gates, scoring
from gaugeworks.plans.rounding import rounded
from gaugeworks.registry import query
from gaugeworks.sources.adapters import ITEMS, items, read


def _cells(keys: str) -> str:
    return f"""
        c AS (SELECT {keys}, template, answer, count(*) AS n, sum(correct_a) AS r FROM ev GROUP BY ALL),
        b AS (SELECT {keys}, template, max(n) AS best, sum(n) AS n, sum(r) AS r FROM c GROUP BY ALL),
        f AS (SELECT {keys}, sum(n)::BIGINT AS n, sum(r) / sum(n) AS accuracy, sum(best) / sum(n) AS floor FROM b GROUP BY ALL)"""


def _report(name: str, keys: list[str]) -> str:
    cols = ", ".join(f"{k if k in keys else 'NULL'} AS {k}" for k in ("grp", "fmt", "dist"))
    group = ", ".join([*keys, "template"])
    outer = "GROUP BY " + ", ".join(keys) if keys else ""
    return f"""
        SELECT '{name}' AS slice, {cols}, sum(n)::BIGINT AS n, sum(r) / sum(n) AS accuracy, sum(best) / sum(n) AS floor
        FROM (SELECT {group}, max(n) AS best, sum(n) AS n, sum(r) AS r
              FROM (SELECT {group}, answer, count(*) AS n, sum(correct_a) AS r FROM ev GROUP BY ALL) GROUP BY ALL) {outer}"""


REPORT = " UNION ALL ".join(
    _report(n, k) for n, k in (("bucket", ["grp", "dist"]), ("bucket_format", ["grp", "fmt", "dist"]), ("format", ["fmt", "dist"]), ("dist", ["dist"]), ("overall", []))
)


@query("agg01_stratified_report", f"WITH {ITEMS}, r AS ({REPORT}) SELECT slice, grp, fmt, dist, n, round(accuracy, 6) AS accuracy, round(floor, 6) AS floor, round(accuracy - floor, 6) AS margin, (slice = 'bucket' AND n >= 2) AS in_mean FROM r")
def agg01(spark, sf_dir):
    report = scoring.stratified_report(items(spark, sf_dir).withColumn("correct", F.col("correct_a")))
    return rounded(report, "accuracy", "floor", "margin")


@query("agg01_bucket_mean", f"""WITH {ITEMS}, r AS ({REPORT})
    SELECT round(avg(accuracy) FILTER (slice = 'bucket' AND n >= 2), 6) AS bucket_mean, count(*) FILTER (slice = 'bucket' AND n >= 2) AS n_buckets,
           round(max(accuracy) FILTER (slice = 'overall'), 6) AS acc_overall, round(max(accuracy) FILTER (slice = 'dist' AND dist = 'ID'), 6) AS acc_id,
           round(max(accuracy) FILTER (slice = 'dist' AND dist = 'OOD'), 6) AS acc_ood FROM r""")
def agg01_mean(spark, sf_dir):
    report = scoring.stratified_report(items(spark, sf_dir).withColumn("correct", F.col("correct_a")))
    return rounded(scoring.bucket_mean(report), "bucket_mean", "acc_overall", "acc_id", "acc_ood")


@query("agg02_template_floor", f"WITH {ITEMS}, {_cells('grp, dist')} SELECT grp, dist, n, round(floor, 6) AS floor FROM f")
def agg02(spark, sf_dir):
    return rounded(scoring.template_floor(items(spark, sf_dir), ["grp", "dist"]), "floor")


@query("agg03_floor_by_format", f"WITH {ITEMS}, {_cells('fmt, dist')} SELECT fmt, dist, n, round(accuracy, 6) AS accuracy, round(floor, 6) AS floor, round(accuracy - floor, 6) AS margin FROM f")
def agg03(spark, sf_dir):
    return rounded(scoring.cells(items(spark, sf_dir), ["fmt", "dist"], "correct_a"), "accuracy", "floor", "margin")


@query("agg60_margin_by_template", f"WITH {ITEMS}, {_cells('dist')}, g AS (SELECT template, dist, count(*) AS n, avg(correct_a) AS acc, max(cnt) / count(*) AS floor FROM (SELECT *, count(*) OVER (PARTITION BY template, dist, answer) AS cnt FROM ev) GROUP BY ALL) SELECT template, dist, n, round(acc, 6) AS accuracy, round(floor, 6) AS floor, round(acc - floor, 6) AS margin, floor >= 1 AS degenerate FROM g")
def agg60(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("one", F.lit("t"))
    done = scoring.cells(rows, ["template", "dist"], "correct_a", template="one")
    return rounded(done.withColumn("degenerate", F.col("floor") >= 1), "accuracy", "floor", "margin")


@query("agg35_answer_profile", f"""WITH {ITEMS}, c AS (SELECT dist, pred, count(*) AS n, sum(correct_a) AS r FROM ev GROUP BY ALL),
    t AS (SELECT dist, sum(n) AS total, sum(r) AS all_right, arg_max(pred, n * 1000 - pred) AS mode, max(n) AS top_n, arg_max(r, n * 1000 - pred) AS top_r FROM c GROUP BY dist),
    h AS (SELECT dist, sum(-n / total * log2(n / total)) AS entropy FROM c JOIN t USING (dist) GROUP BY dist)
    SELECT dist, total::BIGINT AS total, mode::BIGINT AS mode, round(top_n / total, 6) AS mode_share, round(top_r / top_n, 6) AS acc_on_mode,
           round((all_right - top_r) / nullif(total - top_n, 0), 6) AS acc_off_mode, round(entropy, 6) AS entropy FROM t JOIN h USING (dist)""")
def agg35(spark, sf_dir):
    done = scoring.answer_profile(items(spark, sf_dir), ["dist"], "pred", "correct_a")
    return rounded(done.withColumn("mode", F.col("mode").cast("long")), "mode_share", "acc_on_mode", "acc_off_mode", "entropy")


@query("agg52_bucket_floors", f"""WITH {ITEMS}, {_cells('grp')}, k AS (SELECT grp, fmt, count(*) AS n, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, fmt) AS rn FROM ev GROUP BY grp, fmt),
    q AS (SELECT grp, count(DISTINCT template) AS templates FROM ev GROUP BY grp)
    SELECT grp, f.n, round(floor, 6) AS floor, templates, round(f.n / templates, 6) AS per_template, (SELECT string_agg(fmt || ':' || k.n, ', ' ORDER BY rn) FROM k WHERE k.grp = f.grp AND rn <= 3) AS formats
    FROM f JOIN q USING (grp)""")
def agg52(spark, sf_dir):
    rows = items(spark, sf_dir)
    floor = scoring.template_floor(rows, ["grp"])
    templates = rows.groupBy("grp").agg(F.count_distinct("template").alias("templates"))
    counted = rows.groupBy("grp", "fmt").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "fmt"))), 1, 3)
    formats = counted.groupBy("grp").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["fmt"], F.lit(":"), (-x["m"]).cast("string"))), ", ").alias("formats"))
    done = floor.join(templates, "grp").join(formats, "grp").withColumn("per_template", F.col("n") / F.col("templates"))
    return rounded(done, "floor", "per_template")


@query("agg54_coverage", f"""WITH {ITEMS}, k AS (SELECT * FROM ev WHERE ('0x' || substr(md5('3|cov|' || event_id), 1, 8))::UBIGINT / 4294967296.0 < 0.3),
    c AS (SELECT e.fmt, count(*) AS "full", (SELECT count(*) FROM k WHERE k.fmt = e.fmt) AS kept FROM ev e GROUP BY e.fmt)
    SELECT fmt, "full", kept, round(kept / "full", 6) AS frac FROM (SELECT * FROM c UNION ALL SELECT 'ALL', sum("full")::BIGINT, sum(kept)::BIGINT FROM c)""")
def agg54(spark, sf_dir):
    rows = items(spark, sf_dir)
    return rounded(scoring.coverage(rows.filter(uniform(3, "cov", F.col("event_id")) < 0.3), rows, "fmt"), "frac")


@query("agg55_share_drift", f"""WITH {ITEMS}, k AS (SELECT * FROM ev WHERE ('0x' || substr(md5('3|cov|' || event_id), 1, 8))::UBIGINT / 4294967296.0 < 0.3),
    a AS (SELECT template, count(*) / (SELECT count(*) FROM ev) AS full_share FROM ev GROUP BY template),
    b AS (SELECT template, count(*) / (SELECT count(*) FROM k) AS sample_share FROM k GROUP BY template)
    SELECT template, round(full_share, 6) AS full_share, round(coalesce(sample_share, 0), 6) AS sample_share, round(coalesce(sample_share, 0) - full_share, 6) AS drift FROM a LEFT JOIN b USING (template)""")
def agg55(spark, sf_dir):
    rows = items(spark, sf_dir)
    return rounded(scoring.share_drift(rows.filter(uniform(3, "cov", F.col("event_id")) < 0.3), rows, "template"), "full_share", "sample_share", "drift")


@query("agg56_weighted_mean", f"WITH {ITEMS}, c AS (SELECT fmt, grp, avg(correct_a) AS a, count(*) AS n FROM ev GROUP BY ALL) SELECT fmt, round(sum(a * n) / sum(n), 6) AS acc FROM c GROUP BY fmt")
def agg56(spark, sf_dir):
    cells = items(spark, sf_dir).groupBy("fmt", "grp").agg(F.avg("correct_a").alias("a"), F.count(F.lit(1)).alias("n"))
    return rounded(scoring.weighted_mean(cells, ["fmt"], "a", "n", "acc"), "acc")


@query("agg58_latency_report", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM events")
def agg58(spark, sf_dir):
    return rounded(scoring.latency_report(read(spark, sf_dir, "events"), "value"), "mean", "p50", "p95", "p99", "max")


@query("add02_strata_gap", f"WITH {ITEMS}, e AS (SELECT *, k % 2 = 0 AS flag FROM ev), c AS (SELECT fmt, dist, flag, template, answer, count(*) AS n, sum(correct_a) AS r FROM e GROUP BY ALL), b AS (SELECT fmt, dist, flag, template, max(n) AS best, sum(n) AS n, sum(r) AS r FROM c GROUP BY ALL), f AS (SELECT fmt, dist, flag, sum(n) AS n, sum(r) / sum(n) - sum(best) / sum(n) AS m FROM b GROUP BY ALL HAVING sum(n) >= 10), g AS (SELECT fmt, dist, max(m) FILTER (flag) AS w, max(m) FILTER (NOT flag) AS o FROM f GROUP BY ALL) SELECT fmt, dist, round(w, 6) AS margin_with, round(o, 6) AS margin_without, round(w - o, 6) AS gap FROM g")
def add02(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("flag", F.col("k") % 2 == 0)
    return rounded(scoring.strata_gap(rows, ["fmt", "dist"], "flag", "correct_a"), "margin_with", "margin_without", "gap")


@query("agg51_data_card", """SELECT event_type AS grp, count(*) AS n, count(DISTINCT user_id) AS n_videos, count(DISTINCT props) AS n_props, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(avg(value), 6) AS mean_value, count(*) FILTER (value IS NULL) AS n_null FROM events GROUP BY event_type""")
def agg51(spark, sf_dir):
    done = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_videos"), F.count_distinct("props").alias("n_props"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"), F.count_if(F.col("value").isNull()).alias("n_null"),
    )
    return rounded(done, "min_value", "max_value", "mean_value")


@query("agg53_split_summary", f"""WITH {ITEMS} SELECT dist, count(*) AS n, count(DISTINCT video) AS n_videos, round(100.0 * count(*) / (SELECT count(*) FROM ev), 6) AS pct FROM ev GROUP BY dist""")
def agg53(spark, sf_dir):
    rows = items(spark, sf_dir)
    n = rows.groupBy("dist").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("video").alias("n_videos"))
    total = n.agg(F.sum("n").alias("total"))
    return rounded(n.crossJoin(F.broadcast(total)).select("dist", "n", "n_videos", (F.lit(100.0) * F.col("n") / F.col("total")).alias("pct")), "pct")


@query("agg57_leaderboard_proxy", f"WITH {ITEMS}, c AS (SELECT grp, avg(correct_a) AS a FROM ev WHERE dist = 'ID' GROUP BY grp) SELECT round((max(a) FILTER (grp = 'click') + max(a) FILTER (grp = 'view')) / 2, 6) AS proxy FROM c")
def agg57(spark, sf_dir):
    cells = items(spark, sf_dir).filter("dist = 'ID'").groupBy("grp").agg(F.avg("correct_a").alias("a"))
    of = lambda g: F.max(F.when(F.col("grp") == g, F.col("a")))
    return rounded(cells.agg(((of("click") + of("view")) / 2).alias("proxy")), "proxy")


@query("gat05_floors_gate", f"WITH {ITEMS}, r AS ({REPORT}) SELECT slice, count(*) AS n_cells, sum(n)::BIGINT AS n_rows FROM r GROUP BY slice")
def gat05(spark, sf_dir):
    report = scoring.stratified_report(items(spark, sf_dir).withColumn("correct", F.col("correct_a")))
    return gates.floors_hold(report).groupBy("slice").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_rows"))
