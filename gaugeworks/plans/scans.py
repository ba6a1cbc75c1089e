"""Scans and sinks: rows read with stated schemas and tags, joined with their metadata, written and read again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.functions import answers, questions
from gaugeworks.functions.draws import uniform
from gaugeworks.operators import gates, sampling
from gaugeworks.plans import ledger
from gaugeworks.plans.rounding import rounded
from gaugeworks.registry import query
from gaugeworks.sources import chat, folders, readers
from gaugeworks.sources.adapters import ITEMS, items, read

#: Events as source rows of a question table: clip of k seconds from the event on; the same in both dialects.
SOURCE = """src AS (SELECT event_id AS id, CASE WHEN event_type IN ('error', 'purchase') THEN 'heico' ELSE 'site' END AS dataset, user_id::VARCHAR AS video, floor(epoch(ts))::BIGINT % 86400 AS s, k,
    'How many ' || event_type || ' at ' || strftime(date_trunc('second', ts), '%H:%M:%S') || '?' AS question, (k % 5)::VARCHAR AS answer
    FROM (SELECT *, regexp_extract(props, '(\\d+)', 1)::INT AS k FROM events))"""


def source_rows(spark, sf_dir):
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    start = (F.unix_timestamp("ts") % 86400).cast("double")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type").isin("error", "purchase"), "heico").otherwise("site").alias("dataset"),
        F.col("user_id").alias("video"),
        questions.seconds_clock(start).alias("timestamp_start"),
        questions.seconds_clock(start + k).alias("timestamp_end"),
        F.concat(F.lit("How many "), "event_type", F.lit(" at "), F.date_format("ts", "HH:mm:ss"), F.lit("?")).alias("question"),
        (k % 5).cast("string").alias("answer"),
    )


def source_items(spark, sf_dir):
    return readers.items_of(source_rows(spark, sf_dir), 2.5)


@query("src01_frame_items", f"WITH {SOURCE} SELECT dataset || '__' || id AS \"qID\", dataset, video, s::DOUBLE AS start, k::DOUBLE AS duration, round_even(s * 2.5, 0)::BIGINT AS frame_index FROM src")
def src01(spark, sf_dir):
    return source_items(spark, sf_dir).select("qID", "dataset", "video", "start", "duration", "frame_index")


@query("src02_request_and_reference", f"WITH {SOURCE} SELECT dataset || '__' || id AS \"qID\", question, answer, round(least(5.0::DOUBLE, 1 + k * 4.0::DOUBLE / 360), 6) AS tolerance, regexp_replace(question, '\\d{{2}}:\\d{{2}}:\\d{{2}}', '<TS>') AS template FROM src")
def src02(spark, sf_dir):
    return rounded(source_items(spark, sf_dir).select("qID", "question", "answer", "tolerance", "template"), "tolerance")


@query("src03_gold_scan", "SELECT 'events__' || event_id AS \"qID\", event_type AS answer FROM events")
def src03(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", readers.path_tag(r"(\w+)\.parquet").alias("dataset"))
    return gates.require(rows, "rows without a data set", F.col("dataset") != "").select(questions.item_id(F.col("dataset"), F.col("event_id")).alias("qID"), F.col("event_type").alias("answer"))


@query("src04_segment_rows", f"""WITH {SOURCE}, n AS (SELECT dataset, video, id, CASE WHEN id % 2 = 0 THEN ceil(k / least(5.0::DOUBLE, 1.0 + k * 4.0::DOUBLE / 360.0))::INT + 1 ELSE 4 END AS frames FROM src)
    SELECT dataset, video, id, frames, max(frames) OVER (PARTITION BY dataset, video) AS fine, greatest(ceil(max(frames) OVER (PARTITION BY dataset, video) / 8.0)::INT, 1) AS stride FROM n""")
def src04(spark, sf_dir):
    rows = source_items(spark, sf_dir).select("dataset", "video", F.split("qID", "__")[1].cast("long").alias("id"), "duration")
    rows = rows.select("dataset", "video", "id", questions.frames_for(F.col("duration"), F.col("id") % 2 == 0).alias("frames"))
    most = rows.groupBy("dataset", "video").agg(F.max("frames").alias("fine"))
    return rows.join(most, ["dataset", "video"]).select("dataset", "video", "id", "frames", "fine", F.greatest(F.ceil(F.col("fine") / 8.0).cast("int"), F.lit(1)).alias("stride"))


@query("src05_tagged_union", "SELECT 'orders' AS dataset, 'train' AS split, o_orderkey AS key, NULL AS line FROM orders UNION ALL SELECT 'lineitem', 'test', l_orderkey, l_linenumber FROM lineitem")
def src05(spark, sf_dir):
    tables = {("orders", "train"): f"{sf_dir}/orders.parquet", ("lineitem", "test"): f"{sf_dir}/lineitem.parquet"}
    rows = readers.tagged_union(spark, tables)
    return rows.select("dataset", "split", F.coalesce("o_orderkey", "l_orderkey").alias("key"), F.col("l_linenumber").alias("line"))


@query("src06_single_question_frames", f"WITH {ITEMS}, f AS (SELECT qid, video, t // 600 AS frame FROM ev) SELECT qid, count(*) OVER (PARTITION BY video, frame) AS n, count(*) OVER (PARTITION BY video, frame) = 1 AS is_single FROM f")
def src06(spark, sf_dir):
    rows = items(spark, sf_dir).select("qid", "video", F.floor(F.col("t") / 600).alias("frame"))
    sizes = rows.groupBy("video", "frame").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes, ["video", "frame"]).select("qid", "n", (F.col("n") == 1).alias("is_single"))


@query("win02_group_size", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, count(*) OVER (PARTITION BY o_custkey) > 10 AS many FROM orders")
def win02(spark, sf_dir):
    n = F.count(F.lit(1)).over(Window.partitionBy("o_custkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), (n > 10).alias("many"))


@query("src07_question_index", f"WITH {SOURCE} SELECT dataset || '__' || video || '__' || s AS frame_key, dataset AS origin, dataset || '__' || id AS \"qID\", k % 5 AS task FROM src".replace("k % 5 AS task", "answer AS task"))
def src07(spark, sf_dir):
    return source_items(spark, sf_dir).select(questions.cache_name(F.col("dataset"), F.col("video"), F.col("start").cast("long")).alias("frame_key"), F.col("dataset").alias("origin"), "qID", F.col("answer").alias("task"))


@query("src08_split_from_id", f"WITH {SOURCE} SELECT CASE dataset WHEN 'heico' THEN 'OOD' ELSE 'ID' END AS split, CASE k % 5 WHEN 0 THEN 'object_recognition' WHEN 1 THEN 'temporal_grounding' WHEN 2 THEN 'aggregation' WHEN 3 THEN 'event_understanding' ELSE 'complex_reasoning' END AS grp, count(*) AS n FROM src GROUP BY ALL")
def src08(spark, sf_dir):
    leaf = F.concat((F.col("answer").cast("int") + 1).cast("string"), F.lit("b"))
    rows = source_items(spark, sf_dir).select(questions.distribution_of(F.col("qID")).alias("split"), questions.leaf_group(leaf).alias("grp"))
    return rows.groupBy("split", "grp").agg(F.count(F.lit(1)).alias("n"))


@query("src09_corpus_seconds", f"WITH {SOURCE} SELECT 'events' AS ds, id, s AS start_s, s + k AS end_s FROM src")
def src09(spark, sf_dir):
    rows = source_rows(spark, sf_dir).select("id", questions.clock_seconds(F.col("timestamp_start")).cast("long").alias("start_s"), questions.clock_seconds(F.col("timestamp_end")).cast("long").alias("end_s"))
    return rows.withColumn("ds", F.lit("events"))


def _predictions(spark, sf_dir):
    """qID, prediction, as JSON lines on the shared folder and read back with the stated schema."""
    path = folders.fresh_path(spark, "predictions")
    items(spark, sf_dir).select(F.col("qid").alias("qID"), F.col("pred").cast("string").alias("content"), F.lit(0.5).alias("latency")).write.json(path)
    return spark.read.schema(readers.PREDICTIONS).json(path)


@query("src10_predictions_with_video", f"""WITH {ITEMS} SELECT qid AS "qID", pred::VARCHAR AS prediction, CASE WHEN k >= 20 THEN video END AS video FROM ev""")
def src10(spark, sf_dir):
    results = items(spark, sf_dir).filter("k >= 20").select(F.col("qid").alias("qID"), "video")
    twice = results.unionByName(results).groupBy("qID").agg(F.min("video").alias("video"))
    return _predictions(spark, sf_dir).select("qID", F.col("content").alias("prediction")).join(twice, "qID", "left")


@query("src11_predictions_map", f"WITH {ITEMS} SELECT qid AS \"qID\", pred::VARCHAR AS content FROM ev")
def src11(spark, sf_dir):
    return gates.unique(_predictions(spark, sf_dir).select("qID", "content"), ["qID"])


@query("src13_positive_frames", """WITH f AS (SELECT l_orderkey AS video, l_linenumber AS frame, max((l_quantity::INT % 5 = 0)::INT) AS has FROM lineitem GROUP BY ALL), g AS (SELECT *, min(frame) FILTER (has = 1) OVER (PARTITION BY video) AS first FROM f)
    SELECT video, count(*) AS n_frames, min(first) AS first, count(*) FILTER (has = 1) AS n_positive, count(*) FILTER (has = 1 AND frame >= first) AS n_after FROM g GROUP BY video""")
def src13(spark, sf_dir):
    tuples = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.collect_list(F.array((F.col("l_quantity").cast("int") % 5), F.col("l_suppkey").cast("int"))).alias("tuples"))
    nested = tuples.groupBy(F.col("l_orderkey").alias("video")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), "tuples"))).alias("annotations"))
    found = readers.positives_of(nested, 0)
    return found.select("video", "n_frames", "first", "n_positive", F.col("n_positive").alias("n_after"))


@query("src14_annotated_images", """SELECT o_orderkey AS key, o_orderpriority AS path, l_linenumber AS anno, l_quantity::INT AS answer FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'N'""")
def src14(spark, sf_dir):
    images = read(spark, sf_dir, "orders").select("o_custkey", F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("path")).alias("image"), F.col("o_orderkey").alias("key"))
    annos = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.struct("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").alias("anno"))
    per_image = annos.groupBy("key").agg(F.collect_list("anno").alias("annos"))
    nested = images.join(per_image, "key").select(F.array("image").alias("images"), "annos")
    each = nested.select(F.explode("images").alias("i"), "annos").select("i.*", F.explode("annos").alias("a")).filter("a.l_orderkey = id and a.l_returnflag = 'N'")
    return each.select(F.col("id").alias("key"), "path", F.col("a.l_linenumber").alias("anno"), F.col("a.l_quantity").cast("int").alias("answer"))


@query("src15_counts_with_provenance", f"""WITH {ITEMS}, c AS (SELECT CASE WHEN k % 3 = 0 THEN k % 9 ELSE event_id % 4 END AS value, CASE WHEN k % 3 = 0 THEN 'field' ELSE 'points' END AS source_of FROM ev)
    SELECT source_of, value, count(*) AS n, value BETWEEN 3 AND 8 AS in_range FROM c GROUP BY ALL""")
def src15(spark, sf_dir):
    points = F.when(F.col("k") % 3 != 0, F.array_repeat(F.lit(1), (F.col("event_id") % 4).cast("int")))
    rows = items(spark, sf_dir).select(F.when(F.col("k") % 3 == 0, F.col("k") % 9).alias("count"), points.alias("points"))
    done = readers.counts_with_provenance(rows, "count", "points").groupBy("source_of", F.col("value").cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return done.withColumn("in_range", F.col("value").between(3, 8))


@query("src16_contents_in_order", f"WITH {ITEMS} SELECT video, string_agg(pred::VARCHAR, ',' ORDER BY event_id) AS contents FROM ev GROUP BY video")
def src16(spark, sf_dir):
    rows = gates.bounded_groups(items(spark, sf_dir), ["video"])
    ordered = F.array_sort(F.collect_list(F.struct("event_id", F.col("pred").cast("string").alias("c"))))
    return rows.groupBy("video").agg(F.array_join(F.transform(ordered, lambda x: x["c"]), ",").alias("contents"))


@query("src17_rehosted_paths", "SELECT o_orderkey, '/new/root/' || o_custkey || '/' || o_orderkey || '.png' AS image FROM orders")
def src17(spark, sf_dir):
    path = F.concat(F.lit("/old/"), "o_custkey", F.lit("/"), "o_orderkey", F.lit(".png"))
    rows = readers.rehost(read(spark, sf_dir, "orders").select("o_orderkey", F.array(path).alias("images")), "images", "/old/", "/new/root/")
    return rows.select("o_orderkey", F.col("images")[0].alias("image"))


@query("src18_frame_names", f"WITH {ITEMS} SELECT event_id, grp AS dataset, video, lpad(k::VARCHAR, 4, '0') AS frame FROM ev")
def src18(spark, sf_dir):
    name = F.concat_ws("__", "grp", "video", F.lpad(F.col("k").cast("string"), 4, "0"))
    rows = items(spark, sf_dir).select("event_id", readers.frame_name_parts(name).alias("p"))
    return gates.require(rows, "names of other than three parts", F.col("p").isNotNull()).select("event_id", "p.*")


@query("src19_phrase_census", "SELECT lang, source, count(*) AS n, count(*) FILTER (contains(lower(text), ' the ')) AS with_phrase, bool_and(regexp_matches(text, '[.]\\s*$')) AS all_end_in_period FROM documents GROUP BY ALL")
def src19(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.contains(F.lower("text"), F.lit(" the "))).alias("with_phrase"), F.bool_and(F.col("text").rlike(r"[.]\s*$")).alias("all_end_in_period")
    )


@query("src20_tolerant_json", f"WITH {ITEMS} SELECT event_id, CASE WHEN k % 7 <> 0 THEN k END AS k FROM ev")
def src20(spark, sf_dir):
    broken = F.when(F.regexp_extract("props", r"(\d+)", 1).cast("int") % 7 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", F.from_json(broken, "k int")["k"].alias("k"))


@query("src22_layer_features", "WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) SELECT vec_id, (pos - 1) // 16 AS layer, min(label) AS label, round(avg(v::DOUBLE), 5) AS mean, count(*) AS dim FROM x GROUP BY ALL")
def src22(spark, sf_dir):
    layers = F.transform(F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / 16).cast("int")), lambda i: F.struct(i.cast("long").alias("layer"), F.slice("embedding", i * 16 + 1, 16).alias("v")))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(layers).alias("x"))
    mean = F.aggregate(F.transform("x.v", lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v) / F.size("x.v")
    return rounded(rows.select("vec_id", "x.layer", "label", mean.alias("mean"), F.size("x.v").cast("long").alias("dim")), "mean", places=5)


# --- sinks


SPLIT = """sp AS (SELECT dist, video, CASE WHEN row_number() OVER (PARTITION BY dist ORDER BY md5('0|v|' || video), video) <= CASE WHEN count(*) OVER (PARTITION BY dist) = 1 THEN 0 ELSE greatest(1, round_even(count(*) OVER (PARTITION BY dist) * 0.2, 0)) END
    THEN 'val_id' ELSE 'train' END AS split FROM (SELECT DISTINCT dist, video FROM ev))"""


def written_split(spark, sf_dir):
    """The cluster split as a manifest with its digest, read back and verified."""
    path = folders.fresh_path(spark, "split")
    split = sampling.cluster_split(items(spark, sf_dir), "dist", "video", 0.2)
    chat.write_manifest(split, path, ["dist", "video", "split"])
    return chat.read_manifest(spark, path, ["dist", "video", "split"])


@query("snk01_manifest", f"WITH {ITEMS}, {SPLIT} SELECT * FROM sp")
def snk01(spark, sf_dir):
    return written_split(spark, sf_dir)


@query("gat09_verified_manifest", f"WITH {ITEMS}, {SPLIT} SELECT dist, split, count(*) AS n, count(DISTINCT video) AS n_videos FROM sp GROUP BY ALL")
def gat09(spark, sf_dir):
    return written_split(spark, sf_dir).groupBy("dist", "split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("video").alias("n_videos"))


@query("snk02_frozen_sample", f"WITH {ITEMS}, r AS (SELECT qid, fmt, row_number() OVER (PARTITION BY fmt ORDER BY md5('0|e|' || qid), qid) AS rn FROM ev) SELECT qid, fmt FROM r WHERE rn <= 40")
def snk02(spark, sf_dir):
    path = folders.fresh_path(spark, "sample")
    chat.write_manifest(sampling.equal_per_cell(items(spark, sf_dir).select("qid", "fmt"), ["fmt"], "qid", 40), path, ["qid", "fmt"])
    return chat.read_manifest(spark, path, ["qid", "fmt"])


@query("snk03_run_of_path", f"WITH {ITEMS} SELECT event_id, grp AS experiment, 'r' || video AS run FROM ev")
def snk03(spark, sf_dir):
    path = F.concat(F.lit("/x/experiments/"), "grp", F.lit("/runs/r"), "video", F.lit("/stratified.json"))
    experiment, run = ledger.run_of_path(path)
    return items(spark, sf_dir).select("event_id", experiment.alias("experiment"), run.alias("run"))


@query("snk04_report_json", f"WITH {ITEMS}, c AS (SELECT grp, dist, count(*) AS n, avg(correct_a) AS a FROM ev GROUP BY ALL) SELECT grp, dist, n, round(a, 6) AS accuracy, CASE WHEN n > 0 THEN sum(n) OVER () END::BIGINT AS n_total FROM c")
def snk04(spark, sf_dir):
    cells = items(spark, sf_dir).groupBy("grp", "dist").agg(F.count(F.lit(1)).alias("n"), F.avg("correct_a").alias("accuracy"), F.lit(float("nan")).alias("floor"))
    line = ledger.report_json(cells, {"experiment": "e1"})
    schema = "n_total long, by_bucket array<struct<grp:string,dist:string,n:long,accuracy:double,floor:double>>"
    back = line.select(F.from_json("report", schema).alias("r")).select("r.n_total", F.explode("r.by_bucket").alias("b")).select("b.*", "n_total")
    gates.require(back, "NaN is null in JSON", F.col("floor").isNull())
    return rounded(back.drop("floor"), "accuracy")


@query("snk05_clean_values", f"WITH {ITEMS} SELECT event_id, CASE WHEN k % 5 > 1 THEN round(value, 6) END AS value FROM ev")
def snk05(spark, sf_dir):
    odd = F.when(F.col("k") % 5 == 0, F.lit(float("nan"))).when(F.col("k") % 5 == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return rounded(items(spark, sf_dir).select("event_id", ledger.clean(odd).alias("value")), "value")


@query("snk07_markdown_rows", f"WITH {ITEMS}, c AS (SELECT grp, count(*) AS n, round(avg(correct_a), 6) AS a FROM ev GROUP BY grp) SELECT '| ' || grp || ' | ' || n || ' | ' || printf('%.4f', a) || ' |' AS line FROM c")
def snk07(spark, sf_dir):
    cells = rounded(items(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("correct_a").alias("a")), "a")
    return cells.select(ledger.markdown_line(cells, ["grp", "n", "a"]).alias("line"))


@query("snk08_formatted_cells", f"WITH {ITEMS} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS flag, CASE WHEN k % 3 = 0 THEN '' ELSE printf('%.4f', k / 8) END AS value FROM ev")
def snk08(spark, sf_dir):
    rows = items(spark, sf_dir).select("event_id", (F.col("k") % 2 == 0).alias("flag"), F.when(F.col("k") % 3 != 0, F.col("k") / 8).alias("value"))
    return rows.select("event_id", ledger.cell(rows, "flag").alias("flag"), ledger.cell(rows, "value").alias("value"))


@query("snk09_delta_sections", f"WITH {ITEMS} SELECT 'by_group' AS section, grp, NULL AS fmt, round(avg(correct_b - correct_a), 6) AS delta FROM ev GROUP BY grp UNION ALL SELECT 'by_format', NULL, fmt, round(avg(correct_b - correct_a), 6) FROM ev GROUP BY fmt UNION ALL SELECT 'all', NULL, NULL, round(avg(correct_b - correct_a), 6) FROM ev")
def snk09(spark, sf_dir):
    rows, delta = items(spark, sf_dir), F.avg(F.col("correct_b") - F.col("correct_a")).alias("delta")
    return rounded(ledger.sections({"by_group": rows.groupBy("grp").agg(delta), "by_format": rows.groupBy("fmt").agg(delta), "all": rows.agg(delta)}).select("section", "grp", "fmt", "delta"), "delta")


@query("snk11_corpus_pair", "WITH r AS (SELECT conv_id::VARCHAR AS key, count(*) AS n_turns FROM conversations GROUP BY conv_id) SELECT key, n_turns, n_turns AS n_meta FROM r")
def snk11(spark, sf_dir):
    rows = chat.chat_rows(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    path = folders.fresh_path(spark, "corpus")
    rows.select("key", "messages").write.json(f"{path}/rows")
    rows.select("key", F.col("n_turns").cast("long").alias("n_meta")).write.json(f"{path}/meta")
    back = chat.read_json_lines(spark, f"{path}/rows").select("key", F.size("messages").cast("long").alias("n_turns"))
    return back.join(chat.read_json_lines(spark, f"{path}/meta", "key string, n_meta long"), "key")


@query("snk12_augmented_rows", f"WITH {ITEMS} SELECT qid, '/aug/' || video || '.png' AS image FROM ev WHERE ('0x' || substr(md5('12|aug|' || qid), 1, 8))::UBIGINT / 4294967296.0 < 0.3 UNION ALL SELECT qid, '/base/' || video || '.png' FROM ev WHERE ('0x' || substr(md5('12|aug|' || qid), 1, 8))::UBIGINT / 4294967296.0 >= 0.3")
def snk12(spark, sf_dir):
    chosen = uniform(12, "aug", F.col("qid")) < 0.3
    return items(spark, sf_dir).select("qid", F.concat(F.when(chosen, "/aug/").otherwise("/base/"), "video", F.lit(".png")).alias("image"))


@query("snk13_flipped_rows", "SELECT sha256(p_name) || ':' || p_partkey AS row_key, ('0x' || substr(md5('24|flip|' || sha256(p_name) || ':' || p_partkey), 1, 8))::UBIGINT / 4294967296.0 < 0.25 AS flipped FROM part")
def snk13(spark, sf_dir):
    key = F.concat(F.sha2("p_name", 256), F.lit(":"), F.col("p_partkey").cast("string"))
    return read(spark, sf_dir, "part").select(key.alias("row_key"), (uniform(24, "flip", key) < 0.25).alias("flipped"))


@query("smp10_bernoulli_by_key", f"WITH {ITEMS} SELECT grp, count(*) AS n, count(*) FILTER (('0x' || substr(md5('10|flip|' || qid), 1, 8))::UBIGINT / 4294967296.0 < 0.5) AS flipped FROM ev GROUP BY grp")
def smp10(spark, sf_dir):
    return items(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(uniform(10, "flip", F.col("qid")) < 0.5).alias("flipped"))


@query("snk15_parsed_predictions", f"WITH {ITEMS} SELECT qid, CASE WHEN k % 4 = 0 THEN '' ELSE 'a' || pred END AS content FROM ev")
def snk15(spark, sf_dir):
    raw = F.when(F.col("k") % 4 == 0, F.concat(F.lit("thinking of "), "pred")).otherwise(F.concat(F.lit("hm</think> a"), "pred"))
    return items(spark, sf_dir).select("qid", answers.split_thinking(raw)["answer"].alias("content"))


@query("snk18_frame_index", f"WITH {ITEMS} SELECT video || '__' || t // 3600 AS frame, count(*) AS n_questions, string_agg(DISTINCT fmt, ',' ORDER BY fmt) AS inventory, sum(correct_a)::BIGINT AS right_a, sum(correct_b)::BIGINT AS right_b FROM ev GROUP BY 1")
def snk18(spark, sf_dir):
    frame = questions.cache_name(F.col("video"), F.floor(F.col("t") / 3600))
    runs = F.struct(F.struct(F.col("pred"), F.col("correct_a").alias("correct")).alias("a"), F.struct(F.col("pred"), F.col("correct_b").alias("correct")).alias("b"))
    rows = gates.bounded_groups(items(spark, sf_dir).withColumn("frame", frame), ["frame"])
    index = rows.groupBy("frame").agg(F.array_sort(F.collect_set("fmt")).alias("inventory"), F.collect_list(F.struct("qid", runs.alias("runs"))).alias("questions"))
    right = lambda run: F.size(F.filter("questions", lambda q: q["runs"][run]["correct"] == 1)).cast("long")
    return index.select("frame", F.size("questions").cast("long").alias("n_questions"), F.array_join("inventory", ",").alias("inventory"), right("a").alias("right_a"), right("b").alias("right_b"))


@query("idx03_files_and_rows", "SELECT 'orders' AS file, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer")
def idx03(spark, sf_dir):
    out = None
    for name in ("orders", "lineitem", "customer"):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(readers.path_tag(r"(\w+)\.parquet").alias("file"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("idx04_key_inventory", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props::JSON)) AS key FROM events) GROUP BY key")
def idx04(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
