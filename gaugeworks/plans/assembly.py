"""Splits, compositions of joins, corpus parts, further readers and gates over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.functions import answers, questions
from gaugeworks.functions.draws import order_key
from gaugeworks.operators import comparing, gates, joining, labelling, sampling, scoring
from gaugeworks.operators.ranges import place_within
from gaugeworks.plans.rounding import rounded
from gaugeworks.plans.scans import SOURCE, SPLIT, source_items
from gaugeworks.plans.texts import FLAGS, RAW, flag_texts, raw_answers
from gaugeworks.registry import query
from gaugeworks.sources.adapters import ITEMS, SETS, items, order_sets, read


# --- projections


@query("prj03_distribution_of_id", f"WITH {SOURCE} SELECT dataset || '__' || id AS \"qID\", CASE dataset WHEN 'heico' THEN 'OOD' ELSE 'ID' END AS dist FROM src")
def prj03(spark, sf_dir):
    return source_items(spark, sf_dir).select("qID", questions.distribution_of(F.col("qID")).alias("dist"))


@query("prj04_manifest_override", f"WITH {ITEMS}, {SPLIT} SELECT ev.qid, CASE WHEN sp.split = 'val_id' THEN 'OOD' ELSE 'ID' END AS dist FROM ev LEFT JOIN sp ON ev.dist = sp.dist AND ev.video = sp.video")
def prj04(spark, sf_dir):
    rows = items(spark, sf_dir)
    split = sampling.cluster_split(rows, "dist", "video", 0.2)
    return rows.select("qid", "dist", "video").join(split, ["dist", "video"], "left").select("qid", F.when(F.col("split") == "val_id", "OOD").otherwise("ID").alias("dist"))


@query("prj05_cluster_key", f"WITH {ITEMS} SELECT grp || '__' || video AS cluster, count(*) AS n FROM ev GROUP BY 1")
def prj05(spark, sf_dir):
    return items(spark, sf_dir).groupBy(questions.item_id(F.col("grp"), F.col("video")).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("prj06_correct_column", f"WITH {ITEMS} SELECT qid, correct_a AS correct FROM ev")
def prj06(spark, sf_dir):
    rows = items(spark, sf_dir).select("qid", (F.col("correct_a") == 1).alias("is_correct"), F.lit("x").alias("other"))
    return rows.select("qid", questions.first_column(rows, ("correctness", "correct", "is_correct")).cast("int").cast("double").alias("correct"))


@query("prj07_correctness_frame", f"WITH {ITEMS} SELECT qid AS \"qID\", correct_b AS correct FROM ev")
def prj07(spark, sf_dir):
    rows = items(spark, sf_dir).select(F.col("qid").alias("question_id"), F.col("correct_b").alias("correctness"))
    return rows.select(questions.first_column(rows, ("qID", "qid_", "question_id", "id")).alias("qID"), questions.first_column(rows, ("correctness", "correct")).cast("double").alias("correct"))


@query("prj09_apply_split", f"WITH {ITEMS}, {SPLIT} SELECT qid FROM ev WHERE (dist, video) IN (SELECT dist, video FROM sp WHERE split = 'train')")
def prj09(spark, sf_dir):
    rows = items(spark, sf_dir)
    return sampling.apply_split(rows, sampling.cluster_split(rows, "dist", "video", 0.2), ["dist", "video"], "train").select("qid")


@query("prj10_apply_sample", f"WITH {ITEMS}, r AS (SELECT qid, row_number() OVER (PARTITION BY fmt ORDER BY md5('0|e|' || qid), qid) AS rn FROM ev) SELECT qid, answer FROM ev WHERE qid IN (SELECT qid FROM r WHERE rn <= 40)")
def prj10(spark, sf_dir):
    rows = items(spark, sf_dir)
    chosen = sampling.equal_per_cell(rows, ["fmt"], "qid", 40).select("qid")
    gates.contained(chosen, rows, ["qid"])
    return rows.join(chosen, "qid", "left_semi").select("qid", "answer")


@query("prj11_composed_filters", f"WITH {ITEMS}, {SPLIT} SELECT qid, grp || ': ' || template AS question FROM ev WHERE (dist, video) IN (SELECT dist, video FROM sp WHERE split = 'val_id') AND k IN (SELECT k FROM ev WHERE grp = 'error') ORDER BY qid LIMIT 300")
def prj11(spark, sf_dir):
    rows = items(spark, sf_dir)
    held = sampling.apply_split(rows, sampling.cluster_split(rows, "dist", "video", 0.2), ["dist", "video"], "val_id")
    wanted = rows.filter("grp = 'error'").select("k").distinct()
    return held.join(wanted, "k", "left_semi").select("qid", F.concat("grp", F.lit(": "), "template").alias("question")).orderBy("qid").limit(300)


ASKED = """asked AS (SELECT event_id, grp, k, t, CASE k % 4 WHEN 0 THEN 'When, as hh:mm:ss, is ' || grp || '?' WHEN 1 THEN 'In % how long is ' || grp || '?' WHEN 2 THEN 'For how long does ' || grp || ' last?' ELSE 'How many ' || grp || ' are there?' END AS question FROM ev)"""


def asked(spark, sf_dir):
    of = lambda a, b: F.concat(F.lit(a), "grp", F.lit(b))
    k = F.col("k") % 4
    question = F.when(k == 0, of("When, as hh:mm:ss, is ", "?")).when(k == 1, of("In % how long is ", "?")).when(k == 2, of("For how long does ", " last?")).otherwise(of("How many ", " are there?"))
    return items(spark, sf_dir).select("event_id", "grp", "k", "t", question.alias("question"))


@query("prj12_time_grid_router", f"WITH {ITEMS}, {ASKED} SELECT event_id, contains(question, 'hh:mm:ss') OR contains(question, 'In %') OR contains(question, 'format xx%') AS routed FROM asked")
def prj12(spark, sf_dir):
    return asked(spark, sf_dir).select("event_id", questions.needs_time_grid(F.col("question")).alias("routed"))


@query("prj13_duration_router", f"WITH {ITEMS}, {ASKED} SELECT event_id, contains(lower(question), 'how long') AS is_duration FROM asked")
def prj13(spark, sf_dir):
    return asked(spark, sf_dir).select("event_id", questions.mentions(F.col("question"), ("how long",)).alias("is_duration"))


@query("prj14_tolerances", "SELECT o_orderkey, round(least(5.0::DOUBLE, 1.0 + (o_totalprice / 1000)::DOUBLE * 4.0::DOUBLE / 360.0::DOUBLE), 6) AS tolerance FROM orders")
def prj14(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", questions.threshold_seconds((F.col("o_totalprice") / 1000).cast("double")).alias("tolerance"))
    return rounded(rows, "tolerance")


@query("prj21_nearest_grid_point", """WITH g AS (SELECT event_id, (event_id % 97)::DOUBLE AS x, greatest(1.0::DOUBLE, event_id % 50)::DOUBLE AS dur FROM events), n AS (SELECT event_id, x, dur, least(greatest(round_even(x / (dur / 3), 0), 0), 3) * (dur / 3) AS nearest FROM g)
    SELECT event_id, round(nearest, 6) AS nearest, abs(x - nearest) <= least(5.0::DOUBLE, 1.0 + dur * 4.0::DOUBLE / 360.0::DOUBLE) AS reached FROM n""")
def prj21(spark, sf_dir):
    at, dur = (F.col("event_id") % 97).cast("double"), F.greatest(F.lit(1.0), (F.col("event_id") % 50).cast("double"))
    near = questions.nearest_of_grid(at, dur, F.lit(4))
    return rounded(read(spark, sf_dir, "events").select("event_id", near.alias("nearest"), (F.abs(at - near) <= questions.threshold_seconds(dur)).alias("reached")), "nearest")


@query("prj29_count_targets", f"WITH {ITEMS}, {ASKED} SELECT event_id, grp AS label, '{{\"label\":\"' || grp || '\",\"counts\":' || (k % 9) || '}}' AS target FROM asked WHERE k % 4 = 3")
def prj29(spark, sf_dir):
    rows = asked(spark, sf_dir).withColumn("label", questions.count_label(F.col("question"))).filter("label is not null")
    return rows.select("event_id", "label", questions.count_target(F.col("label"), F.col("k") % 9).alias("target"))


@query("prj33_decision", f"""WITH {ITEMS}, m AS (SELECT video, avg(correct_b - correct_a) FILTER (dist = 'ID') AS id, avg(correct_b - correct_a) FILTER (dist = 'OOD') AS ood FROM ev GROUP BY video)
    SELECT video, CASE WHEN id IS NULL OR ood IS NULL THEN 'INDETERMINATE' WHEN id > 0 AND ood > 0 AND (id + ood) / 2 >= 0.05 THEN 'WIN' ELSE 'NO-WIN' END AS decision FROM m""")
def prj33(spark, sf_dir):
    of = lambda d: F.avg(F.when(F.col("dist") == d, F.col("correct_b") - F.col("correct_a")))
    rows = items(spark, sf_dir).groupBy("video").agg(of("ID").alias("id"), of("OOD").alias("ood"))
    clauses = [F.col("id") > 0, F.col("ood") > 0, (F.col("id") + F.col("ood")) / 2 >= 0.05]
    return rows.select("video", comparing.decide(clauses).alias("decision"))


@query("prj35_correct_by_format", f"WITH {FLAGS} SELECT key, CASE key % 3 WHEN 0 THEN a = b WHEN 1 THEN len(string_split(a, ', ')) = (CASE WHEN b = 'none' THEN 0 ELSE len(string_split(b, ', ')) END) END AS correct FROM s")
def prj35(spark, sf_dir):
    fmt = F.element_at(F.array(F.lit("fo_class"), F.lit("number"), F.lit("open")), (F.col("key") % 3 + 1).cast("int"))
    size = lambda c: F.when(F.col(c) == "none", 0).otherwise(answers.count_items(F.col(c))).cast("string")
    number = fmt == "number"
    told = [F.when(number, size(c)).otherwise(F.col(c)) for c in ("a", "b")]
    return flag_texts(spark, sf_dir).select("key", answers.correct_for(fmt, told[1], told[0], ["A", "N", "R"]).alias("correct"))


@query("prj36_set_membership", f"WITH {SETS} SELECT key, list_contains(gold, 'A') AS in_gold, list_contains(pred, 'A') AS in_pred FROM os")
def prj36(spark, sf_dir):
    return order_sets(spark, sf_dir).select("key", F.array_contains("gold", "A").alias("in_gold"), F.array_contains("pred", "A").alias("in_pred"))


# --- joins


@query("jon05_paired_vs_control", f"WITH {ITEMS} SELECT 'ALL' AS half, count(*) AS n, round(avg(correct_b) - avg(correct_a), 6) AS delta FROM ev UNION ALL SELECT dist, count(*), round(avg(correct_b) - avg(correct_a), 6) FROM ev GROUP BY dist")
def jon05(spark, sf_dir):
    rows = items(spark, sf_dir)
    pairs = comparing.pair_arms(rows.select("qid", F.col("correct_a").alias("correct")), rows.select("qid", F.col("correct_b").alias("correct"))).join(rows.select("qid", "dist"), "qid")
    return rounded(comparing.halves(pairs, "dist"), "delta")


@query("jon06_arm_by_format", f"WITH {ITEMS} SELECT fmt, count(*) AS n, round(avg(correct_a), 6) AS control, round(avg(correct_b), 6) AS arm FROM ev WHERE fmt = 'fo_class' GROUP BY fmt")
def jon06(spark, sf_dir):
    rows = items(spark, sf_dir).filter("fmt = 'fo_class'")
    pairs = comparing.pair_arms(rows.select("qid", F.col("correct_a").alias("correct")), rows.select("qid", F.col("correct_b").alias("correct")))
    done = rows.select("qid", "fmt").join(pairs, "qid").groupBy("fmt").agg(F.count(F.lit(1)).alias("n"), F.avg("correct_a").alias("control"), F.avg("correct_b").alias("arm"))
    return rounded(done, "control", "arm")


@query("jon09_frame_scores", f"WITH {ITEMS}, f AS (SELECT user_id::VARCHAR AS video, round(avg(value), 6) AS score FROM events GROUP BY 1) SELECT qid, grp || '__' || ev.video AS video, correct_a, score FROM ev LEFT JOIN f ON ev.video = f.video")
def jon09(spark, sf_dir):
    scores = rounded(read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("frame")).agg(F.avg("value").alias("score")), "score")
    rows = items(spark, sf_dir).select("qid", F.col("video").alias("frame"), questions.item_id(F.col("grp"), F.col("video")).alias("video"), "correct_a")
    return rows.join(scores, "frame", "left").select("qid", "video", "correct_a", "score")


@query("jon18_join_rate", "SELECT count(*) AS n, count(c_custkey) AS found, round(count(c_custkey) / count(*), 6) AS join_rate FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def jon18(spark, sf_dir):
    wanted = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    done = joining.join_rate(wanted, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "key")
    return rounded(gates.require(done, "join rate", F.col("join_rate") >= 0.5), "join_rate")


@query("jon20_probe_into_score", f"WITH {SETS}, p AS (SELECT key, gold, pred, least(len(gold), 1 + key % 2) AS n FROM os) SELECT key, array_to_string(pred[1:n], ',') AS cut, pred[1:n] = gold AS right_cut, pred = gold AS right_now, len(pred) > n AS shortened FROM p")
def jon20(spark, sf_dir):
    sets = order_sets(spark, sf_dir)
    probe = sets.select("key", F.least(F.size("gold"), (F.lit(1) + F.col("key") % 2).cast("int")).alias("n"))
    gates.same_keys(probe, sets, ["key"])
    joined = sets.join(probe, "key")
    cut = F.slice("pred", F.lit(1), F.col("n"))
    return joined.select("key", F.array_join(cut, ",").alias("cut"), (cut == F.col("gold")).alias("right_cut"), (F.col("pred") == F.col("gold")).alias("right_now"), (F.size("pred") > F.col("n")).alias("shortened"))


@query("jon21_models_union", f"WITH {ITEMS} SELECT 'a' AS model, grp, sum(correct_a)::BIGINT AS n_right, count(*) AS n FROM ev GROUP BY grp UNION ALL SELECT 'b', grp, sum(correct_b)::BIGINT, count(*) FROM ev GROUP BY grp")
def jon21(spark, sf_dir):
    rows = items(spark, sf_dir)
    each = [rows.select("qid", F.col(f"correct_{m}").alias("correct")).join(rows.select("qid", "grp"), "qid").withColumn("model", F.lit(m)) for m in ("a", "b")]
    return each[0].unionByName(each[1]).groupBy("model", "grp").agg(F.sum("correct").cast("long").alias("n_right"), F.count(F.lit(1)).alias("n"))


# --- aggregates, orders and sets


@query("agg24_mean_class_f1", f"""WITH {SETS}, e AS (SELECT gold, pred, unnest(list_distinct(list_concat(gold, pred))) AS class FROM os),
    c AS (SELECT class, count(*) FILTER (list_contains(gold, class) AND list_contains(pred, class)) AS tp, count(*) FILTER (NOT list_contains(gold, class)) AS fp, count(*) FILTER (NOT list_contains(pred, class)) AS fn FROM e GROUP BY class)
    SELECT round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1, count(*) AS n_classes FROM c WHERE tp + fn > 0""")
def agg24(spark, sf_dir):
    counts = labelling.class_counts(order_sets(spark, sf_dir), [])
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return rounded(counts.filter("tp + fn > 0").agg(F.avg(f1).alias("macro_f1"), F.count(F.lit(1)).alias("n_classes")), "macro_f1")


@query("agg36_usable_templates", f"WITH {ITEMS} SELECT template, count(DISTINCT answer) AS n_answers FROM ev WHERE fmt = 'number' GROUP BY template HAVING count(DISTINCT answer) >= 4")
def agg36(spark, sf_dir):
    rows = items(spark, sf_dir).filter("fmt = 'number'").groupBy("template").agg(F.count_distinct("answer").alias("n_answers"))
    return rows.filter("n_answers >= 4")


@query("agg59_margin_delta", f"""WITH {ITEMS}, c AS (SELECT dist, template, answer, count(*) AS n FROM ev WHERE fmt = 'number' GROUP BY ALL), f AS (SELECT dist, sum(most) / sum(n) AS floor FROM (SELECT dist, template, max(n) AS most, sum(n) AS n FROM c GROUP BY ALL) GROUP BY dist),
    a AS (SELECT dist, avg(correct_a) AS a, avg(correct_b) AS b FROM ev WHERE fmt = 'number' GROUP BY dist) SELECT dist, round(a - floor, 6) AS margin_a, round(b - floor, 6) AS margin_b, round(b - a, 6) AS delta FROM a JOIN f USING (dist)""")
def agg59(spark, sf_dir):
    rows = items(spark, sf_dir).filter("fmt = 'number'")
    modes = rows.groupBy("dist", "template", "answer").agg(F.count(F.lit(1)).alias("n")).groupBy("dist", "template").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    floors = modes.groupBy("dist").agg((F.sum("most") / F.sum("n")).alias("floor"))
    done = rows.groupBy("dist").agg(F.avg("correct_a").alias("a"), F.avg("correct_b").alias("b")).join(floors, "dist")
    return rounded(done.select("dist", (F.col("a") - F.col("floor")).alias("margin_a"), (F.col("b") - F.col("floor")).alias("margin_b"), (F.col("b") - F.col("a")).alias("delta")), "margin_a", "margin_b", "delta")


@query("win10_latest_by_group", f"WITH {ITEMS} SELECT grp, max_by(qid, (t, event_id)) AS latest, round(sum(correct_a * k) / sum(k), 6) AS weighted FROM ev GROUP BY grp")
def win10(spark, sf_dir):
    latest = F.max_by("qid", F.struct("t", "event_id"))
    return rounded(items(spark, sf_dir).groupBy("grp").agg(latest.alias("latest"), (F.sum(F.col("correct_a") * F.col("k")) / F.sum("k")).alias("weighted")), "weighted")


@query("top01_reading_order", f"WITH {ITEMS} SELECT qid, row_number() OVER (PARTITION BY video ORDER BY t, event_id) AS place FROM ev")
def top01(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("video").orderBy("t", "event_id"))
    return items(spark, sf_dir).select("qid", place.alias("place"))


@query("top02_heaviest_first", "WITH c AS (SELECT c_nationkey AS stratum, o_custkey AS key, sum(o_totalprice) AS mass FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT stratum, key, row_number() OVER (PARTITION BY stratum ORDER BY round(mass, 2) DESC, key) AS place FROM c")
def top02(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("stratum"))
    mass = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.round(F.sum("o_totalprice"), 2).alias("mass"))
    return place_within(mass.join(customers, "key").select("stratum", "key", "mass"), ["stratum"], ["-mass", "key"], "place").select("stratum", "key", "place")


@query("top03_modal_answer", f"WITH {ITEMS}, n AS (SELECT video, answer, count(*) AS n FROM ev GROUP BY ALL) SELECT video, arg_max(answer, n * 100 - answer) AS modal, max(n) AS n FROM n GROUP BY video")
def top03(spark, sf_dir):
    counted = items(spark, sf_dir).groupBy("video", "answer").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("video").agg(F.max_by("answer", F.struct("n", -F.col("answer"))).alias("modal"), F.max("n").alias("n"))


@query("top05_formats_as_text", f"WITH {ITEMS}, n AS (SELECT grp, template, count(*) AS n FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, template) AS rn FROM n) SELECT grp, string_agg(template || ' ' || n, ', ' ORDER BY rn) AS top FROM r WHERE rn <= 3 GROUP BY grp")
def top05(spark, sf_dir):
    counted = items(spark, sf_dir).groupBy("grp", "template").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "template"))
    top = counted.withColumn("rn", place).filter("rn <= 3").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(" ", "template", F.col("n").cast("string")).alias("s")))).alias("t"))
    return top.select("grp", F.array_join(F.transform("t", lambda x: x["s"]), ", ").alias("top"))


@query("set03_all_matched_gate", f"WITH {ITEMS}, {SPLIT} SELECT split, count(*) AS n FROM ev JOIN sp ON ev.dist = sp.dist AND ev.video = sp.video GROUP BY split")
def set03(spark, sf_dir):
    rows = items(spark, sf_dir)
    split = sampling.cluster_split(rows, "dist", "video", 0.2)
    gates.contained(rows, split, ["dist", "video"])
    return rows.join(split, ["dist", "video"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("set04_corpus_legality", f"WITH {ITEMS}, {SPLIT} SELECT dist, count(DISTINCT video) AS n_videos FROM sp WHERE split = 'train' GROUP BY dist")
def set04(spark, sf_dir):
    rows = items(spark, sf_dir)
    split = sampling.cluster_split(rows, "dist", "video", 0.2)
    corpus = sampling.apply_split(rows, split, ["dist", "video"], "train").select(F.concat(F.lit("/data/"), "dist", F.lit("/"), "video", F.lit(".png")).alias("path"))
    videos = corpus.select(F.regexp_extract("path", "/data/([^/]+)/", 1).alias("dist"), F.regexp_extract("path", r"/([^/]+)\.png$", 1).alias("video")).distinct()
    gates.disjoint(videos, split.filter("split = 'val_id'"), ["dist", "video"])
    gates.same_keys(videos, split.filter("split = 'train'"), ["dist", "video"])
    return videos.groupBy("dist").agg(F.count(F.lit(1)).alias("n_videos"))


@query("set05_hit_histogram", "WITH h AS (SELECT DISTINCT l_partkey, l_quantity::INT AS q FROM lineitem) SELECT q, count(*) AS n FROM h GROUP BY q")
def set05(spark, sf_dir):
    hits = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("int").alias("q")).distinct()
    return hits.groupBy("q").agg(F.count(F.lit(1)).alias("n"))


@query("set08_corpus_union", f"WITH {ITEMS}, {SPLIT} SELECT 'base' AS part, count(*) AS n FROM ev WHERE (dist, video) IN (SELECT dist, video FROM sp WHERE split = 'train') UNION ALL SELECT 'new', count(*) FROM orders")
def set08(spark, sf_dir):
    rows = items(spark, sf_dir)
    split = sampling.cluster_split(rows, "dist", "video", 0.2)
    base = sampling.apply_split(rows, split, ["dist", "video"], "train").select(F.lit("base").alias("part"), F.col("video"), F.col("dist"))
    new = read(spark, sf_dir, "orders").select(F.lit("new").alias("part"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("video"), F.lit("ID").alias("dist"))
    corpus = base.unionByName(new)
    gates.disjoint(corpus, split.filter("split = 'val_id'"), ["dist", "video"])
    return corpus.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# --- splits and samples


@query("smp02_sample_by_cluster", f"WITH {ITEMS}, s AS (SELECT video, count(*) AS n FROM ev GROUP BY video), r AS (SELECT ev.video, qid, n, row_number() OVER (PARTITION BY ev.video ORDER BY md5('0|e|' || qid), qid) AS rn FROM ev JOIN s ON ev.video = s.video) SELECT qid FROM r WHERE rn <= greatest(1, round_even(n * 0.1, 0))")
def smp02(spark, sf_dir):
    rows = items(spark, sf_dir)
    sizes = rows.groupBy("video").agg(F.greatest(F.lit(1.0), F.bround(F.count(F.lit(1)) * 0.1, 0)).alias("quota"))
    place = F.row_number().over(Window.partitionBy("video").orderBy(order_key(0, "e", F.col("qid")), "qid"))
    return rows.select("video", "qid", place.alias("rn")).join(sizes, "video").filter("rn <= quota").select("qid")


@query("smp03_file_split", f"WITH {ITEMS} SELECT video, CASE WHEN max_by(grp, (t, event_id)) IN ('error', 'purchase') THEN 'val_ood' WHEN max_by(grp, (t, event_id)) = 'view' THEN 'val_id' ELSE 'train' END AS split FROM ev GROUP BY video")
def smp03(spark, sf_dir):
    last = items(spark, sf_dir).groupBy("video").agg(F.max_by("grp", F.struct("t", "event_id")).alias("grp"))
    return last.select("video", F.when(F.col("grp").isin("error", "purchase"), "val_ood").when(F.col("grp") == "view", "val_id").otherwise("train").alias("split"))


@query("smp16_templates_of_numbers", f"WITH {ITEMS}, {ASKED} SELECT event_id, question FROM asked WHERE regexp_matches(lower(question), 'how many\\s+(click|view)')")
def smp16(spark, sf_dir):
    return asked(spark, sf_dir).filter(F.lower("question").rlike(r"how many\s+(click|view)")).select("event_id", "question")


@query("smp20_equal_per_format", f"WITH {ITEMS}, r AS (SELECT qid, fmt, row_number() OVER (PARTITION BY fmt, dist ORDER BY md5('20|e|' || qid), qid) AS rn FROM ev) SELECT qid, fmt FROM r WHERE rn <= 25")
def smp20(spark, sf_dir):
    return sampling.equal_per_cell(items(spark, sf_dir), ["fmt", "dist"], "qid", 25, seed=20).select("qid", "fmt")


@query("smp21_balanced_slice", f"WITH {ITEMS}, r AS (SELECT qid, dist, row_number() OVER (PARTITION BY dist ORDER BY md5('21|e|' || qid), qid) AS rn FROM ev WHERE fmt = 'binary') SELECT qid, dist FROM r WHERE rn <= 60")
def smp21(spark, sf_dir):
    return sampling.equal_per_cell(items(spark, sf_dir).filter("fmt = 'binary'"), ["dist"], "qid", 60, seed=21).select("qid", "dist")


# --- readers of answers


@query("scl08_container_normaliser", "WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_quantity::INT || ' .' WHEN 1 THEN 'No.' ELSE l_quantity::INT || ' pieces.' END AS t, l_quantity::INT AS q FROM lineitem) SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN q::VARCHAR WHEN 1 THEN 'no' ELSE t END AS answer FROM t")
def scl08(spark, sf_dir):
    q = F.col("l_quantity").cast("int").cast("string")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat(q, F.lit(" ."))).when(F.col("l_linenumber") % 3 == 1, "No.").otherwise(F.concat(q, F.lit(" pieces.")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", answers.normalise_answer(text).alias("answer"))


@query("scl14_points_in_text", """WITH l AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT key, CASE key % 4 WHEN 0 THEN 'unparseable' WHEN 1 THEN 'malformed' ELSE 'ok' END AS status, CASE WHEN key % 4 > 1 THEN n ELSE 0 END AS n FROM l""")
def scl14(spark, sf_dir):
    pairs = F.concat(F.lit("["), F.array_join(F.transform(F.collect_list(F.col("l_linenumber").cast("string")), lambda x: F.concat(F.lit("["), x, F.lit(", 2.5]"))), ", "), F.lit("]"))
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(pairs.alias("pairs"))
    text = F.when(F.col("key") % 4 == 0, "none there").when(F.col("key") % 4 == 1, '["a", {"x": 1}]').otherwise(F.concat(F.lit("Points: "), "pairs"))
    return rows.select("key", answers.points_in(text).alias("p")).select("key", "p.status", F.size("p.points").cast("long").alias("n"))


@query("scl15_count_by_arm", f"WITH {RAW} SELECT event_id, CASE WHEN regexp_full_match(trim(text), '\\d+') THEN trim(text)::INT END AS bare, CASE WHEN k % 2 = 0 THEN k % 6 ELSE 0 END AS points, CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN k % 6 + 1 END AS numbered FROM raw")
def scl15(spark, sf_dir):
    k = F.col("k")
    pointed = F.when(k % 2 == 0, F.concat(F.lit("x ["), F.array_join(F.array_repeat(F.lit('{"point_2d": [1, 2]}'), k % 6), ","), F.lit("] y"))).otherwise("nothing")
    listed = F.when(k % 3 == 0, "None").when(k % 3 == 1, F.concat(F.lit("1. a\n"), (k % 6 + 1).cast("string"), F.lit(". b"))).otherwise("some things")
    return raw_answers(spark, sf_dir).select("event_id", answers.bare_count(F.col("text")).alias("bare"), answers.count_points(pointed).alias("points"), answers.last_number(listed).alias("numbered"))


@query("scl21_item_numbers", f"WITH {FLAGS} SELECT key, len(string_split(a, ', ')) AS n FROM s")
def scl21(spark, sf_dir):
    return flag_texts(spark, sf_dir).select("key", answers.count_items(F.concat("a", F.lit(", ,"))).alias("n"))


@query("scl23_comparison_keys", f"WITH {FLAGS} SELECT key, array_to_string(list_sort(string_split(lower(a), ', ')), ',') AS same_key, a <> b AS disagree FROM s")
def scl23(spark, sf_dir):
    reversed_a = F.array_join(F.reverse(F.split("a", ", ")), " ,")
    key = answers.comparison_key
    return flag_texts(spark, sf_dir).select("key", key(reversed_a).alias("same_key"), (key(F.col("a")) != key(F.col("b"))).alias("disagree"))


@query("scl26_frame_keys", f"WITH {SOURCE} SELECT dataset || '__' || id AS \"qID\", dataset || '__' || video || '__' || s AS frame_key FROM src")
def scl26(spark, sf_dir):
    return source_items(spark, sf_dir).select("qID", questions.cache_name(F.col("dataset"), F.col("video"), F.col("start").cast("long")).alias("frame_key"))


@query("scl27_frame_names", f"WITH {SOURCE} SELECT dataset || '__' || video || '__' || round_even(s * 2.5, 0)::BIGINT AS name, count(*) AS n FROM src GROUP BY 1")
def scl27(spark, sf_dir):
    rows = source_items(spark, sf_dir).select(F.concat_ws("__", "dataset", "video", F.col("frame_index").cast("string")).alias("name"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("scl33_target_share_weights", "WITH s AS (SELECT source, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY source) SELECT source, round(0.25 * (1 - share) / (share * 0.75), 6) AS weight FROM s WHERE share < 1")
def scl33(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.lit(docs.count())
    return rounded(sizes.select("source", share.alias("share")).filter("share < 1").select("source", scoring.weight_for_share(F.col("share"), 0.25).alias("weight")), "weight")


# --- gates


@query("gat01_rows_grouped_gate", f"WITH {ITEMS} SELECT grp, count(*) AS n FROM ev GROUP BY grp")
def gat01(spark, sf_dir):
    rows = items(spark, sf_dir)
    return gates.every_leaf_has_group(rows, questions.leaf_group(F.concat((F.col("k") % 5 + 1).cast("string"), F.lit("a")))).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("gat02_f1_reported_gate", f"WITH {ITEMS} SELECT dist, count(*) FILTER (fmt = 'fo_class') AS n FROM ev GROUP BY dist")
def gat02(spark, sf_dir):
    rows = items(spark, sf_dir)
    needed = rows.filter("fmt = 'fo_class'").select("dist").distinct()
    row = rows.filter("fmt = 'fo_class'").groupBy("dist").agg(F.avg("correct_a").alias("macro_f1")).filter("macro_f1 is not null")
    gates.contained(needed, row, ["dist"])
    return rows.groupBy("dist").agg(F.count_if(F.col("fmt") == "fo_class").alias("n"))


@query("gat03_bucket_set_gate", f"WITH {ITEMS} SELECT DISTINCT grp, dist FROM ev")
def gat03(spark, sf_dir):
    rows = items(spark, sf_dir)
    cells = read(spark, sf_dir, "events").select(F.col("event_type").alias("grp")).distinct().withColumn("dist", F.when(F.col("grp").isin("error", "purchase"), "OOD").otherwise("ID"))
    found = rows.select("grp", "dist").distinct()
    gates.same_keys(found, cells, ["grp", "dist"])
    return found


@query("gat08_two_means_gate", f"WITH {ITEMS}, c AS (SELECT grp, dist, avg(correct_a) AS a FROM ev GROUP BY ALL HAVING count(*) >= 2) SELECT round(avg(a), 6) AS bucket_mean FROM c")
def gat08(spark, sf_dir):
    rows = items(spark, sf_dir)
    ours = scoring.bucket_mean(scoring.stratified_report(rows, "correct_a")).select(F.col("bucket_mean"))
    theirs = rows.groupBy("grp", "dist").agg(F.avg("correct_a").alias("a"), F.count(F.lit(1)).alias("n")).filter("n >= 2").agg(F.avg("a")).first()[0]
    gates.close_to(ours.first()[0], theirs, 0.02, "bucket mean")
    return rounded(ours, "bucket_mean")


@query("gat12_same_ids_gate", f"WITH {ITEMS} SELECT count(*) AS n FROM ev")
def gat12(spark, sf_dir):
    rows = items(spark, sf_dir)
    returned = rows.select(F.concat_ws("__", "grp", F.col("event_id").cast("string")).alias("qid"))
    return gates.same_keys(returned, rows, ["qid"]).agg(F.count(F.lit(1)).alias("n"))


@query("gat13_references_gate", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def gat13(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    gates.known_values(rows, "o_orderstatus", ["F", "O", "P"])
    gates.contained(rows.select(F.col("o_custkey").alias("key")), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), ["key"])
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("gat15_floors_cancel_gate", f"WITH {ITEMS} SELECT grp, dist, count(*) AS n FROM ev GROUP BY ALL")
def gat15(spark, sf_dir):
    rows = items(spark, sf_dir)
    floors = [scoring.stratified_report(rows, c).filter("slice = 'bucket'").select(F.concat_ws("|", "grp", "dist").alias("cell"), "floor") for c in ("correct_a", "correct_b")]
    gates.identical(floors[0], floors[1], "cell", "floor")
    return rows.groupBy("grp", "dist").agg(F.count(F.lit(1)).alias("n"))


@query("gat19_no_held_out_cluster_gate", f"WITH {ITEMS}, {SPLIT} SELECT count(*) AS minted FROM ev WHERE (dist, video) IN (SELECT dist, video FROM sp WHERE split = 'train') AND fmt = 'number' AND answer = 0")
def gat19(spark, sf_dir):
    rows = items(spark, sf_dir)
    split = sampling.cluster_split(rows, "dist", "video", 0.2)
    minted = sampling.apply_split(rows, split, ["dist", "video"], "train").filter("fmt = 'number' and answer = 0")
    return gates.disjoint(minted, split.filter("split = 'val_id'"), ["dist", "video"]).agg(F.count(F.lit(1)).alias("minted"))


@query("gat20_licensed_change_gate", f"WITH {FLAGS} SELECT count(*) AS n, sum(len(string_split(a, ', ')))::BIGINT AS told FROM s")
def gat20(spark, sf_dir):
    told = flag_texts(spark, sf_dir).withColumn("told", questions.add_count_prefix(F.col("a"), answers.count_items(F.col("a"))))
    gates.round_trips(told, questions.strip_count_prefix(F.col("told")), "a")
    return told.agg(F.count(F.lit(1)).alias("n"), F.sum(questions.stated_count(F.col("told"))).cast("long").alias("told"))


@query("gat21_untouched_rows_gate", "SELECT count(*) AS n, count(*) FILTER (role = 'assistant') AS rewritten FROM conversations")
def gat21(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", F.md5(F.coalesce("text", F.lit("")))).alias("key"), "role", "text")
    written = rows.withColumn("text", F.when(F.col("role") == "assistant", F.concat(F.lit("1: "), "text")).otherwise(F.col("text")))
    base, new = (x.filter("role <> 'assistant'").groupBy("key").agg(F.min("text").alias("text")) for x in (rows, written))
    gates.identical(base, new, "key", "text")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "assistant").alias("rewritten"))


@query("gat22_legal_parts_gate", f"WITH {ITEMS}, {SPLIT} SELECT split, count(*) AS n FROM sp GROUP BY split")
def gat22(spark, sf_dir):
    rows = items(spark, sf_dir)
    split = sampling.cluster_split(rows, "dist", "video", 0.2)
    held, rest = split.filter("split = 'val_id'"), split.filter("split = 'train'")
    gates.disjoint(held, rest, ["dist", "video"])
    gates.same_keys(held.unionByName(rest), rows.select("dist", "video").distinct(), ["dist", "video"])
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("gat25_rescore_gate", f"WITH {ITEMS} SELECT grp, round(avg(correct_a), 6) AS accuracy FROM ev GROUP BY grp")
def gat25(spark, sf_dir):
    rows = items(spark, sf_dir)
    once, again = (x.groupBy("grp").agg(F.round(F.avg("correct_a"), 6).alias("accuracy")) for x in (rows, rows.repartition(3)))
    gates.identical(once, again, "grp", "accuracy")
    return once


# --- further


@query("udf02_reader_by_format", f"WITH {RAW} SELECT event_id, CASE fmt WHEN 'number' THEN nullif(regexp_extract(text, '^\\s*(\\d+)', 1), '')::INT::VARCHAR WHEN 'binary' THEN CASE WHEN regexp_matches(lower(trim(text)), '^(yes|true)($|[ ,.])') THEN 'yes' WHEN regexp_matches(lower(trim(text)), '^(no|false)($|[ ,.])') THEN 'no' END ELSE trim(text) END AS read_as FROM raw")
def udf02(spark, sf_dir):
    text = F.col("text")
    readers = {"number": answers.read_count(text).cast("int").cast("string"), "binary": answers.key_binary(text)}
    return raw_answers(spark, sf_dir).select("event_id", answers.by_format(F.col("fmt"), readers, F.trim(text)).alias("read_as"))


@query("udf06_parse_log", f"WITH {RAW}, p AS (SELECT fmt, CASE WHEN fmt <> 'number' THEN 'passthrough' WHEN regexp_matches(text, '^\\s*\\d+\\s*$') THEN 'bare_int' WHEN regexp_matches(text, '(?i)counts[\"'']?\\s*:\\s*[\"'']?\\d') THEN 'structured' WHEN len(regexp_extract_all(text, '\\d+')) = 1 THEN 'salvaged' ELSE 'malformed' END AS status FROM raw) SELECT status, count(*) AS n FROM p GROUP BY status")
def udf06(spark, sf_dir):
    status = F.when(F.col("fmt") != "number", "passthrough").otherwise(answers.parse_count(F.col("text"))["status"])
    return raw_answers(spark, sf_dir).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("add10_headline_gate", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem")
def add10(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    done = lines.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_orders"))
    again = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.count(F.lit(1))).first()
    return gates.require(done, "headlines", (F.col("n") == again[0]) & (F.col("n_orders") == again[1]))


@query("add11_slice_metrics", f"""WITH {ITEMS}, e AS (SELECT *, k % 4 AS epoch FROM ev), c AS (SELECT epoch, fmt, template, answer, count(*) AS n FROM e GROUP BY ALL), f AS (SELECT epoch, fmt, sum(most) / sum(n) AS floor FROM (SELECT epoch, fmt, template, max(n) AS most, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL)
    SELECT epoch, fmt, count(*) AS n, round(avg(correct_a), 6) AS acc, round(any_value(floor), 6) AS floor, round(avg(correct_a) - any_value(floor), 6) AS margin FROM e JOIN f USING (epoch, fmt) GROUP BY ALL""")
def add11(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("epoch", F.col("k") % 4)
    by = ["epoch", "fmt"]
    modes = rows.groupBy(*by, "template", "answer").agg(F.count(F.lit(1)).alias("n")).groupBy(*by, "template").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    floors = modes.groupBy(*by).agg((F.sum("most") / F.sum("n")).alias("floor"))
    done = gates.require(rows, "rows without gold", F.col("answer").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("correct_a").alias("acc")).join(floors, by)
    return rounded(done.withColumn("margin", F.col("acc") - F.col("floor")), "acc", "floor", "margin")


@query("add13_format_of_item", f"WITH {ITEMS} SELECT template, count(DISTINCT fmt) AS n_formats, min(fmt) AS first_format FROM ev GROUP BY template")
def add13(spark, sf_dir):
    return items(spark, sf_dir).groupBy("template").agg(F.count_distinct("fmt").alias("n_formats"), F.min("fmt").alias("first_format"))


@query("add15_enumeration_slice", f"WITH {SETS} SELECT len(gold) AS size, count(*) AS n, round(avg((pred = gold)::INT), 6) AS exact FROM os WHERE len(gold) >= 2 GROUP BY 1")
def add15(spark, sf_dir):
    rows = order_sets(spark, sf_dir).filter(F.size("gold") >= 2)
    done = rows.groupBy(F.size("gold").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pred") == F.col("gold")).cast("double")).alias("exact"))
    return rounded(done, "exact")
