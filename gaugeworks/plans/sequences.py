"""Adjacent rows, timelines and nearest rows over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.operators import sequences
from gaugeworks.plans.rounding import rounded
from gaugeworks.registry import query
from gaugeworks.sources.adapters import ITEMS, items, read
from gaugeworks.streaming import progress, run_log

PAIRS = "p AS (SELECT video, event_id, t, lag(event_id) OVER w AS before, t - lag(t) OVER w AS gap, abs(answer - lag(answer) OVER w) AS jump FROM ev WINDOW w AS (PARTITION BY video ORDER BY t, event_id))"


@query("win04_adjacent_pairs", f"WITH {ITEMS}, {PAIRS} SELECT video, event_id, before, gap, jump FROM p WHERE before IS NOT NULL")
def win04(spark, sf_dir):
    return sequences.adjacent_pairs(items(spark, sf_dir), "video", "t", "event_id", "answer").select("video", "event_id", "before", "gap", "jump")


@query("agg49_gap_buckets", f"""WITH {ITEMS}, {PAIRS}, b AS (SELECT CASE WHEN gap > 0 AND gap <= 600 THEN '(0,600]' WHEN gap > 600 AND gap <= 3600 THEN '(600,3600]' WHEN gap > 3600 AND gap <= 86400 THEN '(3600,86400]' END AS bucket, jump FROM p WHERE before IS NOT NULL)
    SELECT bucket, count(*) AS n, round(avg(jump), 6) AS mean_jump, round(avg((jump = 0)::INT), 6) AS same, round(avg((jump >= 3)::INT), 6) AS large, max(jump) AS max_jump FROM b WHERE bucket IS NOT NULL GROUP BY bucket""")
def agg49(spark, sf_dir):
    pairs = sequences.adjacent_pairs(items(spark, sf_dir), "video", "t", "event_id", "answer")
    return rounded(sequences.gap_buckets(pairs, [0, 600, 3600, 86400]), "mean_jump", "same", "large")


@query("win06_template_pairs", f"WITH {ITEMS}, p AS (SELECT video, event_id, template, lead(template) OVER w AS next_template, lead(t) OVER w - t AS gap, greatest(answer, lead(answer) OVER w) AS most FROM ev WINDOW w AS (PARTITION BY video ORDER BY t, event_id)) SELECT video, event_id, gap, CASE WHEN most >= 4 THEN 'J' WHEN most >= 2 THEN 'S' ELSE '-' END AS arm FROM p WHERE template = next_template AND gap > 0 AND most >= 1")
def win06(spark, sf_dir):
    order = Window.partitionBy("video").orderBy("t", "event_id")
    rows = items(spark, sf_dir).select(
        "video", "event_id", "template", F.lead("template").over(order).alias("nt"), (F.lead("t").over(order) - F.col("t")).alias("gap"), F.greatest("answer", F.lead("answer").over(order)).alias("most"), F.lead("t").over(order).alias("more")
    )
    kept = rows.filter("more is not null and template = nt and gap > 0 and most >= 1")
    return kept.select("video", "event_id", "gap", F.when(F.col("most") >= 4, "J").when(F.col("most") >= 2, "S").otherwise("-").alias("arm"))


@query("win07_timeline_states", f"""WITH {ITEMS}, s AS (SELECT video, t, grp, min(t) FILTER (grp = 'purchase') OVER (PARTITION BY video) AS f FROM ev)
    SELECT CASE WHEN f IS NULL OR t < f THEN 'ABSENT' WHEN grp = 'purchase' THEN 'PRESENT' ELSE 'UNKNOWN' END AS state, count(*) AS n FROM s GROUP BY 1""")
def win07(spark, sf_dir):
    done = sequences.timeline_states(items(spark, sf_dir), "video", "t", F.col("grp") == "purchase")
    return done.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("jon14_before_first_event", f"WITH {ITEMS}, s AS (SELECT *, min(t) FILTER (grp = 'error') OVER (PARTITION BY video) AS f FROM ev) SELECT video, event_id FROM s WHERE t < f")
def jon14(spark, sf_dir):
    return sequences.before_first_event(items(spark, sf_dir), "video", "t", F.col("grp") == "error").select("video", "event_id")


@query("jon17_nearest_in_time", f"""WITH {ITEMS}, p AS (SELECT a.video, a.event_id, b.event_id AS neighbour, abs(a.t - b.t) AS gap FROM ev a JOIN ev b ON a.video = b.video AND a.event_id <> b.event_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, event_id ORDER BY gap, neighbour) AS place FROM p) WHERE place <= 2""")
def jon17(spark, sf_dir):
    return sequences.nearest_in_time(items(spark, sf_dir), "video", "t", "event_id", 2)


@query("win01_clip_maximum", f"WITH {ITEMS} SELECT event_id, max(k) OVER (PARTITION BY video, template) AS clip_max, count(*) OVER (PARTITION BY video, template) AS clip_size FROM ev")
def win01(spark, sf_dir):
    clip = Window.partitionBy("video", "template")
    return items(spark, sf_dir).select("event_id", F.max("k").over(clip).alias("clip_max"), F.count(F.lit(1)).over(clip).alias("clip_size"))


@query("win05_differences", f"WITH {ITEMS} SELECT event_id, t - lag(t) OVER w AS dt, k - lag(k) OVER w AS dk FROM ev WINDOW w AS (PARTITION BY video ORDER BY t, event_id)")
def win05(spark, sf_dir):
    order = Window.partitionBy("video").orderBy("t", "event_id")
    return items(spark, sf_dir).select("event_id", (F.col("t") - F.lag("t").over(order)).alias("dt"), (F.col("k") - F.lag("k").over(order)).alias("dk"))


@query("win09_ledger_order", f"WITH {ITEMS}, c AS (SELECT grp, template, avg(CASE WHEN k > 90 THEN correct_a END) AS m FROM ev GROUP BY ALL) SELECT grp, template, round(m, 6) AS m, row_number() OVER (ORDER BY round(m, 9) DESC NULLS LAST, grp, template) AS place FROM c")
def win09(spark, sf_dir):
    cells = items(spark, sf_dir).groupBy("grp", "template").agg(F.avg(F.when(F.col("k") > 90, F.col("correct_a"))).alias("m"))
    order = Window.orderBy(F.desc_nulls_last(F.round("m", 9)), "grp", "template")
    return rounded(cells.withColumn("place", F.row_number().over(order)), "m")


@query("win12_running_rate", f"""WITH {ITEMS}, w AS (SELECT video, event_id, t, count(*) OVER f AS n, min(t) OVER f AS t0 FROM ev WINDOW f AS (PARTITION BY video ORDER BY t, event_id ROWS 63 PRECEDING))
    SELECT video, event_id, t, round((n - 1) / nullif(t - t0, 0), 6) AS rate FROM w""")
def win12(spark, sf_dir):
    return rounded(sequences.running_rate(items(spark, sf_dir), "video", "t", "event_id"), "rate")


@query("win14_sessions", f"""WITH {ITEMS}, g AS (SELECT video, event_id, coalesce((t - lag(t) OVER w > 3600)::INT, 1) AS opens FROM ev WINDOW w AS (PARTITION BY video ORDER BY t, event_id)), e AS (SELECT event_id, t FROM ev)
    SELECT video, event_id, sum(opens) OVER (PARTITION BY video ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g JOIN e USING (event_id)""")
def win14(spark, sf_dir):
    return sequences.sessions(items(spark, sf_dir), "video", "t", "event_id", 3600).select("video", "event_id", "session")


@query("top04_row_of_max", f"WITH {ITEMS} SELECT grp, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value DESC, event_id) AS rn FROM ev) WHERE rn = 1")
def top04(spark, sf_dir):
    best = F.max_by(F.struct("event_id", "value"), F.struct("value", -F.col("event_id")))
    return rounded(items(spark, sf_dir).groupBy("grp").agg(best.alias("b")).select("grp", "b.event_id", "b.value"), "value")


@query("top06_most_common", f"WITH {ITEMS} SELECT template, count(*) AS n FROM ev GROUP BY template ORDER BY n DESC, template LIMIT 4")
def top06(spark, sf_dir):
    return items(spark, sf_dir).groupBy("template").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "template").limit(4)


@query("top07_stratified_head", f"WITH {ITEMS}, r AS (SELECT event_id, grp, row_number() OVER (PARTITION BY grp ORDER BY event_id) AS rn FROM ev) SELECT event_id, grp FROM r WHERE rn <= 10 ORDER BY event_id LIMIT 30")
def top07(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("grp").orderBy("event_id"))
    return items(spark, sf_dir).select("event_id", "grp", place.alias("rn")).filter("rn <= 10").orderBy("event_id").limit(30).select("event_id", "grp")


@query("win11_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def win11(spark, sf_dir):
    return run_log.windowed_counts(read(spark, sf_dir, "events"), "ts", "event_type").select("start", "event_type", "n")


@query("win13_latest_state", "WITH l AS (SELECT user_id::VARCHAR AS run, event_type AS kind, floor(epoch(ts))::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) DESC, event_type DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n_events FROM events) SELECT run, t AS ts, kind, n_events FROM l WHERE rn = 1")
def win13(spark, sf_dir):
    rows = items(spark, sf_dir).select(F.col("t").cast("double").alias("ts"), F.col("video").alias("run"), F.col("grp").alias("kind"), F.lit(None).cast("string").alias("stage"))
    return run_log.latest_state(rows).select("run", "ts", "kind", "n_events")


@query("win12_throttled_reports", f"""WITH RECURSIVE {ITEMS}, l AS (SELECT video AS run, t, event_id, CASE grp WHEN 'purchase' THEN 'stage' WHEN 'error' THEN 'failed' ELSE 'progress' END AS kind, row_number() OVER (PARTITION BY video ORDER BY t, event_id) AS rn, min(t) OVER (PARTITION BY video) AS t0 FROM ev),
    s AS (SELECT *, count(*) FILTER (kind = 'stage') OVER (PARTITION BY run ORDER BY rn) AS stage, max(CASE WHEN kind <> 'progress' THEN rn END) OVER (PARTITION BY run ORDER BY rn) AS turned FROM l),
    p AS (SELECT run, rn, event_id, row_number() OVER w AS place, first_value(t) OVER f AS t_old, first_value(event_id) OVER f AS s_old, count(*) OVER f AS held, t AS t_new FROM s WHERE kind = 'progress' WINDOW w AS (PARTITION BY run, stage ORDER BY rn), f AS (PARTITION BY run, stage ORDER BY rn ROWS 63 PRECEDING)),
    m AS (SELECT s.run, s.rn, max(p.rn) AS at FROM s LEFT JOIN (SELECT p.*, stage FROM p JOIN s USING (run, rn)) p ON p.run = s.run AND p.stage = s.stage AND p.rn <= s.rn GROUP BY ALL),
    due AS (SELECT run, rn, t, true AS due, t AS reported FROM s WHERE rn = 1
        UNION ALL SELECT s.run, s.rn, s.t, s.kind <> 'progress' OR s.t - due.reported >= 28800, CASE WHEN s.kind <> 'progress' OR s.t - due.reported >= 28800 THEN s.t ELSE due.reported END FROM due JOIN s ON s.run = due.run AND s.rn = due.rn + 1)
    SELECT s.run, s.t::DOUBLE AS at, s.event_id AS key, CASE WHEN l2.kind = 'failed' THEN 'failed' ELSE 'running' END AS status, p.event_id AS step, CASE WHEN p.event_id IS NOT NULL THEN 1000000 END AS total,
           format('{{:.2f}}', 100.0::DOUBLE * nullif(p.event_id, 0) / 1000000)::DOUBLE AS pct, format('{{:.1f}}', CASE WHEN held >= 4 AND p.event_id > s_old AND t_new > t_old THEN (1000000 - p.event_id)::DOUBLE * (t_new - t_old) / (p.event_id - s_old) END)::DOUBLE AS eta_seconds, (s.t - s.t0)::DOUBLE AS elapsed_seconds
    FROM s JOIN due ON due.run = s.run AND due.rn = s.rn AND due.due JOIN m ON m.run = s.run AND m.rn = s.rn LEFT JOIN p ON p.run = m.run AND p.rn = m.at LEFT JOIN s l2 ON l2.run = s.run AND l2.rn = s.turned""")
def win12_reports(spark, sf_dir):
    """Users as runs: purchases start a stage, errors fail, other events are steps."""
    kind = F.when(F.col("grp") == "purchase", "stage").when(F.col("grp") == "error", "failed").otherwise("progress")
    log = progress.as_events(items(spark, sf_dir), F.col("video"), F.col("t"), F.col("event_id"), kind, F.col("event_id"), F.lit(1_000_000))
    return progress.reports(log, 28_800.0)
