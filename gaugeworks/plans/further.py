"""Readers, run checks, indexes of notes and probes that complete the survey."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import answers, questions
from gaugeworks.operators import comparing, features, gates, joining, ranges, sampling, scoring
from gaugeworks.plans.assembly import ASKED, asked
from gaugeworks.plans.rounding import rounded
from gaugeworks.plans.scans import SPLIT
from gaugeworks.plans.texts import FLAGS, RAW, flag_texts, raw_answers
from gaugeworks.registry import query
from gaugeworks.sources import chat, folders, index
from gaugeworks.sources.adapters import ITEMS, items, read

# --- readers


@query("scl12_canonical_classes", f"""WITH {FLAGS}, t AS (SELECT key, CASE WHEN key % 7 = 0 THEN a || ', NONE' WHEN key % 5 = 0 THEN a || ', Plug' WHEN key % 3 = 0 THEN a || ', 10:02' WHEN key % 2 = 0 THEN 'None, R' ELSE a END AS text FROM s),
    p AS (SELECT key, text, string_split(text, ', ') AS parts FROM t),
    r AS (SELECT *, CASE WHEN len(list_filter(parts, lambda x: lower(x) <> 'none')) > 0 THEN list_filter(parts, lambda x: lower(x) <> 'none') ELSE parts END AS rest FROM p),
    k AS (SELECT *, list_filter(rest, lambda x: lower(x) IN ('a', 'n')) AS kept, list_filter(rest, lambda x: lower(x) NOT IN ('a', 'n')) AS unknown, len(list_filter(rest, lambda x: NOT regexp_full_match(x, '[A-Za-z][A-Za-z -]{{0,30}}'))) = 0 AS shaped FROM r)
    SELECT key, CASE WHEN len(list_filter(parts, lambda x: lower(x) IN ('a', 'n', 'none'))) = 0 THEN text WHEN len(unknown) > 0 AND len(kept) > 0 AND shaped AND NOT list_contains(unknown, 'Plug') THEN array_to_string(kept, ', ') ELSE array_to_string(rest, ', ') END AS legal FROM k""")
def scl12(spark, sf_dir):
    key, a = F.col("key"), F.col("a")
    text = F.when(key % 7 == 0, F.concat(a, F.lit(", NONE"))).when(key % 5 == 0, F.concat(a, F.lit(", Plug"))).when(key % 3 == 0, F.concat(a, F.lit(", 10:02"))).when(key % 2 == 0, "None, R").otherwise(a)
    return flag_texts(spark, sf_dir).select("key", answers.canonical_classes(text, ["A", "N"], "A plug seen alone.").alias("legal"))


@query("scl16_meant_and_valid", f"""WITH {RAW}, v AS (SELECT event_id, fmt, trim(text) AS s, CASE WHEN fmt = 'number' THEN regexp_replace(nullif(regexp_extract(trim(text), '^(\\d+)', 1), ''), '^0+(\\d)', '\\1') ELSE nullif(lower(regexp_extract(trim(text), '(?i)^(yes|no)\\b', 1)), '') END AS value FROM raw)
    SELECT event_id, value, coalesce(value = CASE WHEN fmt = 'number' THEN '0' ELSE 'no' END, FALSE) AS is_zero, value IS NOT NULL AS parsed, CASE WHEN fmt = 'number' THEN regexp_full_match(s, '\\d+') ELSE lower(s) IN ('yes', 'no') END AS valid FROM v""")
def scl16(spark, sf_dir):
    return raw_answers(spark, sf_dir).select("event_id", answers.meant_and_valid(F.col("text"), F.col("fmt")).alias("r")).select("event_id", "r.*")


@query("scl22_boxes_count", f"""WITH {ITEMS} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN k % 3 + 1 WHEN 2 THEN k % 5 + 1 END::INT AS count, CASE event_id % 4 WHEN 0 THEN 'zero' WHEN 1 THEN 'corrupted_ref' WHEN 2 THEN 'clean' ELSE 'unparsed' END AS category,
    CASE WHEN event_id % 4 = 2 THEN repeat(grp || '|', (k % 5 + 1)::INT) ELSE '' END AS names, 'a/VID' || lpad((k)::VARCHAR, greatest(2, len(k::VARCHAR))::INT, '0') || '/' || event_id || '.png' AS path FROM ev""")
def scl22(spark, sf_dir):
    n = F.col("event_id") % 4
    boxes = F.repeat(F.concat("grp", F.lit(" (1, 20),(30 , 4); ")), F.col("k") % 5 + 1)
    text = F.when(n == 0, " No tools detected here").when(n == 1, F.repeat(F.lit(answers.REFERENCE_TOKEN + "(1,"), F.col("k") % 3 + 1)).when(n == 2, boxes).otherwise("about (3, 4)")
    rows = items(spark, sf_dir).select("event_id", answers.boxes_count(text).alias("r"), answers.padded_video(F.concat(F.lit("a/VID"), "k", F.lit("/"), "event_id", F.lit(".png"))).alias("path"))
    names = F.array_join(F.transform("r.names", lambda x: F.concat(x, F.lit("|"))), "")
    return rows.select("event_id", "r.count", "r.category", names.alias("names"), "path")


# --- checks of runs


@query("gat10_router_and_clock_gates", f"WITH {ITEMS}, {ASKED} SELECT contains(question, 'hh:mm:ss') OR contains(question, 'In %') AS routed, count(*) AS n FROM asked GROUP BY 1")
def gat10(spark, sf_dir):
    rows = asked(spark, sf_dir).withColumn("routed", questions.needs_time_grid(F.col("question")))
    gates.require(rows, "router", F.col("routed") == (F.col("k") % 4 < 2))
    clocks = rows.select(questions.seconds_clock((F.col("t") % 86400).cast("double")).alias("clock"))
    gates.round_trips(clocks, questions.seconds_clock(questions.clock_seconds(F.col("clock"))), "clock")
    gates.contained(rows.select("event_id"), read(spark, sf_dir, "events").select("event_id"), ["event_id"])
    return rows.groupBy("routed").agg(F.count(F.lit(1)).alias("n"))


@query("gat23_difference_in_differences", f"""WITH {ITEMS}, m AS (SELECT template, avg(correct_a) FILTER (dist = 'ID' AND event_id % 2 = 0) AS a0, avg(correct_a) FILTER (dist = 'ID' AND event_id % 2 = 1) AS a1,
        avg(correct_a) FILTER (dist = 'OOD' AND event_id % 2 = 0) AS b0, avg(correct_a) FILTER (dist = 'OOD' AND event_id % 2 = 1) AS b1 FROM ev GROUP BY template)
    SELECT template, CASE WHEN abs(a0 - b0) <= 0.05 THEN 'GREEN' WHEN abs(a0 - b0) > 0.05 THEN 'RED' END AS control, round(a1 - a0, 6) AS effect_a, round(b1 - b0, 6) AS effect_b, round((a1 - a0) - (b1 - b0), 6) AS did,
           CASE WHEN abs((a1 - a0) - (b1 - b0)) <= 0.05 THEN 'SAME_EFFECT' WHEN abs((a1 - a0) - (b1 - b0)) > 0.05 THEN 'NOT_SEPARABLE' END AS verdict FROM m""")
def gat23(spark, sf_dir):
    mean = lambda dist, epoch: F.avg(F.when((F.col("dist") == dist) & (F.col("event_id") % 2 == epoch), F.col("correct_a")))
    cells = items(spark, sf_dir).groupBy("template").agg(mean("ID", 0).alias("a0"), mean("ID", 1).alias("a1"), mean("OOD", 0).alias("b0"), mean("OOD", 1).alias("b1"))
    return rounded(comparing.difference_in_differences(cells, "template", 0.05, ("a0", "b0"), ("a1", "b1")), "effect_a", "effect_b", "did")


@query("gat24_run_liveness", f"""WITH {ITEMS}, r AS (SELECT video, value, correct_b, row_number() OVER (PARTITION BY video ORDER BY t, event_id) AS up, row_number() OVER (PARTITION BY video ORDER BY t DESC, event_id DESC) AS down FROM ev)
    SELECT video, count(value) AS n_logged, round(avg((value > 0)::INT), 6) AS moved, round(avg(correct_b) FILTER (up <= 10), 6) AS first, round(avg(correct_b) FILTER (down <= 10), 6) AS last FROM r GROUP BY video""")
def gat24(spark, sf_dir):
    return rounded(comparing.run_liveness(items(spark, sf_dir), "video", ["t", "event_id"], "value", "correct_b"), "moved", "first", "last")


@query("gat24_argument_diff", """WITH a AS (SELECT 'c' || o_custkey AS name, min(o_orderstatus) AS v FROM orders GROUP BY 1), b AS (SELECT 'c' || o_custkey AS name, max(o_orderstatus) AS v FROM orders WHERE o_totalprice > 50000 GROUP BY 1)
    SELECT coalesce(a.name, b.name) AS name, a.v AS in_a, b.v AS in_b, contains(coalesce(a.name, b.name), '7') AS declared FROM a FULL JOIN b ON a.name = b.name WHERE a.v IS DISTINCT FROM b.v""")
def gat24_arguments(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("name"), "o_orderstatus", "o_totalprice")
    a = rows.groupBy("name").agg(F.min("o_orderstatus").alias("v"))
    b = rows.filter("o_totalprice > 50000").groupBy("name").agg(F.max("o_orderstatus").alias("v"))
    return comparing.argument_diff(a, b, "name", "v", ["7"])


@query("udf04_resumed_run", f"WITH {ITEMS} SELECT qid, upper(trim(template)) || ':' || pred AS answer FROM ev")
def udf04(spark, sf_dir):
    """The first run got through the clicks; the second reads what it wrote and does the others."""
    rows = items(spark, sf_dir).select("qid", "grp", "template", "pred")
    make = lambda x: x.select("qid", F.concat(F.upper(F.trim("template")), F.lit(":"), "pred").alias("answer"))
    path = folders.fresh_path(spark, "predictions")
    make(rows.filter("grp = 'click'")).write.parquet(path)
    return joining.resumed(rows, spark.read.parquet(path), "qid", make)


@query("add14_arms_by_alpha", f"""WITH {ITEMS}, x AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS alpha)
    SELECT alpha, round(avg((1 - alpha) * correct_a + alpha * correct_b) FILTER (dist = 'ID'), 6) AS id, round(avg((1 - alpha) * correct_a + alpha * correct_b) FILTER (dist = 'OOD'), 6) AS ood FROM ev, x GROUP BY alpha""")
def add14(spark, sf_dir):
    sums = items(spark, sf_dir).groupBy("dist").agg(F.avg("correct_a").alias("a"), F.avg("correct_b").alias("b"))
    arms = sums.withColumn("alpha", F.explode(F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)))))
    mixed = (1 - F.col("alpha")) * F.col("a") + F.col("alpha") * F.col("b")
    done = arms.groupBy("alpha").agg(F.max(F.when(F.col("dist") == "ID", mixed)).alias("id"), F.max(F.when(F.col("dist") == "OOD", mixed)).alias("ood"))
    return rounded(done, "id", "ood").orderBy("alpha")


# --- chat records with flags


@query("add07_scaffold_records", f"""WITH {ITEMS} SELECT qid, to_json([{{'role': 'system', 'content': 'Answer.'}}, {{'role': 'user', 'content': '<image>' || grp || '?'}}, {{'role': 'assistant', 'content': '<answer> ' || answer || ' </answer>'}}])::VARCHAR AS messages,
    'site__' || video || '__' || k AS image, event_id % 6 <> 0 AS has_answer, event_id % 6 <> 0 AND answer = pred AS agrees FROM ev""")
def add07(spark, sf_dir):
    """The scaffold of every sixth answer lost its closing tag; the record carries the whole one, the flags judge what came."""
    rows = items(spark, sf_dir)
    whole = F.concat(F.lit("<answer> "), "answer", F.lit(" </answer>"))
    came = F.when(F.col("event_id") % 6 == 0, F.replace(whole, F.lit("</answer>"), F.lit(""))).otherwise(whole)
    told = answers.tag_body(came, "answer")
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.to_json(F.array(turn("system", F.lit("Answer.")), turn("user", F.concat(F.lit("<image>"), "grp", F.lit("?"))), turn("assistant", whole)))
    agrees = F.coalesce(told == F.col("pred").cast("string"), F.lit(False))
    return rows.select("qid", messages.alias("messages"), questions.cache_name(F.lit("site"), F.col("video"), F.col("k")).alias("image"), told.isNotNull().alias("has_answer"), agrees.alias("agrees"))


# --- an index of notes


def notes(spark, sf_dir):
    """A note for every order, as Markdown with front matter and a table."""
    text = F.concat(
        F.lit("---\nquestion: does "), "o_orderkey", F.lit(" hold?\nverdict: "), "o_orderstatus", F.lit("\nstatus: live\ndate: "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit("\n---\n\n| rung | result |\n|---|---|\n| "), "o_orderpriority", F.lit(" | "), F.lit("c\\|"), "o_custkey", F.lit(" |\n"),
    )
    return read(spark, sf_dir, "orders").select(text.alias("value"), F.concat(F.lit("experiments/"), F.year("o_orderdate").cast("string"), F.lit("-x/runs/"), "o_orderkey", F.lit("/note.md")).alias("path"))


@query("idx01_decisions", "SELECT 'does ' || o_orderkey || ' hold?' AS question, o_orderstatus AS verdict, 'live' AS status, strftime(o_orderdate, '%Y-%m-%d') AS date, 'experiments/' || year(o_orderdate) || '-x/runs/' || o_orderkey || '/note.md' AS path FROM orders")
def idx01(spark, sf_dir):
    return index.decisions(notes(spark, sf_dir))


@query("idx02_ladder_rows", """WITH r AS (SELECT o_orderpriority AS rung, 'c|' || o_custkey AS result FROM orders UNION ALL SELECT 'rung', 'result' FROM orders)
    SELECT rung, arg_min(result, (-len(result), result)) AS result FROM r GROUP BY rung""")
def idx02(spark, sf_dir):
    rows = index.table_rows(notes(spark, sf_dir)).select(F.get("cells", F.lit(0)).alias("rung"), F.get("cells", F.lit(1)).alias("result"))
    return index.longest_per_key(rows.distinct(), "rung", "result")


@query("idx05_rendered_sections", """SELECT 1 AS section, '- ' || strftime(o_orderdate, '%Y-%m-%d') || ' does ' || o_orderkey || ' hold? ' || o_orderstatus AS line FROM orders
    UNION ALL SELECT 2, '- ' || o_orderpriority || ' ' || count(*) FROM orders GROUP BY o_orderpriority""")
def idx05(spark, sf_dir):
    found = notes(spark, sf_dir)
    decided = index.decisions(found).select(F.lit(1).alias("section"), F.concat(F.lit("- "), F.concat_ws(" ", "date", "question", "verdict")).alias("line"))
    rungs = index.table_rows(found).groupBy(F.get("cells", F.lit(0)).alias("rung")).agg(F.count(F.lit(1)).alias("n")).filter("rung <> 'rung'")
    return decided.unionByName(rungs.select(F.lit(2).alias("section"), F.concat(F.lit("- "), F.concat_ws(" ", "rung", F.col("n").cast("string"))).alias("line"))).orderBy("section", "line")


@query("idx06_experiments_of_paths", "SELECT year(o_orderdate) || '-x' AS experiment, count(DISTINCT o_orderkey) AS n_runs FROM orders GROUP BY 1")
def idx06(spark, sf_dir):
    found = notes(spark, sf_dir).select(index.experiment_of(F.col("path")).alias("e"))
    return found.groupBy("e.experiment").agg(F.count_distinct("e.run").alias("n_runs"))


# --- probes


@query("agg74_one_vs_rest_probe")
def agg74(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").withColumn("held", F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0)
    return features.one_vs_rest_probe(rows, "embedding", "label", "held")


POINTS = """pts AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unparseable' WHEN event_id % 13 = 0 THEN 'malformed' ELSE 'ok' END AS status, event_id % 4 AS gold_n, k % 4 AS np,
        CASE WHEN k % 3 < 2 THEN least(k % 4, event_id % 4) ELSE 0 END AS hit, fmt = 'number' AS counted, answer = event_id % 4 AS count_correct, k % 5 <> 0 AS legal FROM ev),
    rep AS (SELECT gold_n, count(*) AS n_frames, count(*) FILTER (status <> 'ok') AS n_point_parse_fail, count(*) FILTER (NOT counted) AS n_count_parse_fail, avg(np) FILTER (status = 'ok') AS mean_n_points,
        avg(hit / np) FILTER (status = 'ok' AND np > 0) AS mean_precision, avg(hit / gold_n) FILTER (status = 'ok' AND gold_n > 0) AS mean_coverage,
        avg(count_correct::INT) FILTER (counted) AS count_accuracy, avg((NOT legal)::INT) FILTER (counted) AS illegal_rate FROM pts GROUP BY gold_n)"""


def pointed(spark, sf_dir):
    """Answers that are lists of points, k % 4 of them; gold boxes, event_id % 4 of them, ten apart and five wide."""
    rows = items(spark, sf_dir)
    each = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<bigint>"))
    gold = (F.col("event_id") % 4).cast("bigint")
    at = lambda j: F.concat(F.lit("["), (j * 10 + F.col("k") % 3 * 4).cast("string"), F.lit(", 5]"))
    listed = F.concat(F.lit("So: ["), F.array_join(F.transform(each((F.col("k") % 4).cast("bigint")), at), ", "), F.lit("]"))
    text = F.when(F.col("event_id") % 11 == 0, "nothing").when(F.col("event_id") % 13 == 0, '["x"]').otherwise(listed)
    box = lambda j: F.struct((j * 10).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (j * 10 + 5).cast("double").alias("x1"), F.lit(10.0).alias("y1"))
    read_as = rows.select("fmt", "answer", "k", gold.alias("gold_n"), answers.points_in(text).alias("r"), F.transform(each(gold), box).alias("regions"))
    return read_as.select(
        "gold_n",
        F.col("r.status").alias("status"),
        scoring.point_scores(F.col("r.points"), F.col("regions")).alias("score"),
        F.when(F.col("fmt") == "number", "ok").otherwise("unparsed").alias("count_status"),
        (F.col("answer") == F.col("gold_n")).alias("count_correct"),
        (F.col("k") % 5 != 0).alias("legal"),
    )


@query("agg63_points_by_stratum", f"WITH {ITEMS}, {POINTS} SELECT gold_n, n_frames, n_point_parse_fail, n_count_parse_fail, round(mean_n_points, 6) AS mean_n_points, round(mean_precision, 6) AS mean_precision, round(mean_coverage, 6) AS mean_coverage, round(count_accuracy, 6) AS count_accuracy, round(illegal_rate, 6) AS illegal_rate FROM rep")
def agg63(spark, sf_dir):
    return rounded(scoring.point_report(pointed(spark, sf_dir), "gold_n"), "mean_n_points", "mean_precision", "mean_coverage", "count_accuracy", "illegal_rate")


@query("agg63_point_verdict", f"WITH {ITEMS}, {POINTS}, v AS (SELECT count(*) AS n, max(mean_n_points) - min(mean_n_points) AS s FROM rep WHERE gold_n > 0) SELECT CASE WHEN n < 2 THEN 'inconclusive' WHEN s < 0.25 THEN 'collapse' ELSE 'individuates' END AS verdict, round(s, 6) AS spread FROM v")
def agg63_verdict(spark, sf_dir):
    return rounded(scoring.point_verdict(scoring.point_report(pointed(spark, sf_dir), "gold_n"), "gold_n"), "spread")


# --- corpus files


@query("add09_place_among_equals", f"WITH {ITEMS} SELECT qid, template || '|' || answer AS asked, row_number() OVER (PARTITION BY template, answer ORDER BY qid) AS place FROM ev")
def add09(spark, sf_dir):
    """Which of the items with the same question and answer a row takes, in the order of their ids."""
    rows = items(spark, sf_dir).select("template", "answer", "qid")
    placed = ranges.place_within(rows, ["template", "answer"], ["qid"], "place")
    return placed.select("qid", F.concat_ws("|", "template", F.col("answer").cast("string")).alias("asked"), "place")


@query("add12_manifest_read_back", f"WITH {ITEMS}, {SPLIT} SELECT dist, video, split FROM sp")
def add12(spark, sf_dir):
    path = folders.fresh_path(spark, "manifest")
    chat.write_manifest(sampling.cluster_split(items(spark, sf_dir), "dist", "video", 0.2), path, ["dist", "video", "split"])
    return chat.read_manifest(spark, path, ["dist", "video", "split"])
