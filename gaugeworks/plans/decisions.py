"""Verdicts, policies, chat rows and answers as the survey has them, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import answers, questions
from gaugeworks.operators import comparing, gates, joining, scoring
from gaugeworks.plans.assembly import ASKED, asked
from gaugeworks.plans.comparing import _bootstrap, delta
from gaugeworks.plans.rounding import rounded
from gaugeworks.plans.scoring import REPORT
from gaugeworks.plans.texts import RAW, raw_answers
from gaugeworks.registry import query
from gaugeworks.sources.adapters import ITEMS, items, read

DRAWS = 2000


@query("prj34_arm_verdict_of_cells", f"""WITH {ITEMS}, cells AS (SELECT dist, video, correct_a, correct_b FROM ev UNION ALL SELECT 'ALL', video, correct_a, correct_b FROM ev), {_bootstrap('correct_b - correct_a', DRAWS, 'cells')},
    v AS (SELECT coalesce(string_agg(dist, ',' ORDER BY dist) FILTER (ci_high < 0), '') AS harmed, max(point) FILTER (dist = 'ALL') AS delta, max(ci_low) FILTER (dist = 'ALL') AS low FROM p JOIN c USING (dist))
    SELECT harmed, round(delta, 6) AS delta, CASE WHEN harmed <> '' THEN 'HARM' WHEN low > 0 AND abs(delta) >= 0.01 THEN 'WIN' ELSE 'NULL_RESULT' END AS verdict FROM v""")
def prj34(spark, sf_dir):
    rows = items(spark, sf_dir)
    cells = rows.withColumn("dist", F.explode(F.array("dist", F.lit("ALL"))))
    ci = comparing.cluster_bootstrap(cells, ["dist"], "video", delta(), draws=DRAWS).withColumnRenamed("dist", "cell")
    return rounded(comparing.paired_verdict(ci), "delta")


@query("jon22_probe_gate", f"""WITH {ITEMS}, r AS ({REPORT}), m AS (SELECT max(accuracy - floor) FILTER (dist = 'ID') AS id, max(accuracy - floor) FILTER (dist = 'OOD') AS ood FROM r WHERE slice = 'dist')
    SELECT round(id, 6) AS margin_id, round(ood, 6) AS margin_ood, CASE WHEN id IS NULL OR ood IS NULL THEN 'INDETERMINATE' WHEN id < 0 OR ood < 0 THEN 'STOP' WHEN id > 0 AND ood > 0 THEN 'GO' ELSE 'INDETERMINATE' END AS verdict FROM m""")
def jon22(spark, sf_dir):
    """Scores joined to what is known of the items; all gates before the margins over the floor are read."""
    rows = items(spark, sf_dir)
    scores, known = rows.select("qid", F.col("correct_a").alias("correct")), rows.select("qid", "grp", "fmt", "dist", "template", "answer", "video")
    joined = scores.join(known, "qid", "left")
    gates.require(joined, "rows without metadata", F.col("grp").isNotNull() & F.col("video").isNotNull())
    gates.unique(joined, ["qid"])
    side = F.when(F.substring_index("qid", "__", 1).isin("error", "purchase"), "OOD").otherwise("ID")
    gates.require(joined, "rows whose id says another side", F.col("dist") == side)
    report = gates.floors_hold(scoring.stratified_report(joined)).filter("slice = 'dist'")
    of = lambda d: F.max(F.when(F.col("dist") == d, F.col("margin")))
    margins = report.agg(of("ID").alias("margin_id"), of("OOD").alias("margin_ood"))
    a, b = F.col("margin_id"), F.col("margin_ood")
    verdict = F.when(a.isNull() | b.isNull(), "INDETERMINATE").when((a < 0) | (b < 0), "STOP").when((a > 0) & (b > 0), "GO").otherwise("INDETERMINATE")
    return rounded(margins.withColumn("verdict", verdict), "margin_id", "margin_ood")


CLOCK = "printf('%02d:%02d:%02d', {0} // 3600, {0} % 3600 // 60, {0} % 60)"
SYSTEM = "Answer from the clip."


@query("prj18_chat_row_of_frames", f"""WITH {ITEMS}, {ASKED}, r AS (SELECT a.event_id, a.question, ev.video, a.k % 4 IN (0, 2) AS is_time, ev.t % 5000 AS st, 10 + a.k % 40 AS dur, 4 + a.k % 5 AS kf, 1 + a.k % 2 AS stride,
        CASE a.k % 4 WHEN 0 THEN {CLOCK.format('(ev.t % 5000 + 5)')} || ', ' || {CLOCK.format('(ev.t % 5000 + 17)')} WHEN 2 THEN '00:00:12' ELSE (a.k % 9)::VARCHAR END AS gold,
        CASE a.k % 4 WHEN 0 THEN '00:00:05, 00:00:17' WHEN 2 THEN '00:00:12' ELSE (a.k % 9)::VARCHAR END AS told FROM asked a JOIN ev USING (event_id)),
    g AS (SELECT *, list_sort(list_distinct(list_transform(range(kf), lambda i: least(round_even((st + dur * i / (kf - 1)::DOUBLE) * 2.0, 0)::BIGINT, 9999)))) AS grid FROM r),
    f AS (SELECT *, list_filter(grid, lambda x, i: (i - 1) % stride = 0) AS taken FROM g)
    SELECT event_id, '{SYSTEM}' AS system, '<video>Clip [' || {CLOCK.format('st')} || ' - ' || {CLOCK.format('(st + dur)')} || '] of the procedure.' || chr(10) || question AS asked, told AS assistant,
           array_to_string(list_transform(taken, lambda x: 'v' || video || '/' || x), ',') AS videos, round(CASE WHEN len(taken) > 1 THEN (len(taken) - 1) / dur::DOUBLE ELSE 1.0 END, 6) AS raw_fps,
           len(taken) AS n_frames, kf AS k_fine, CASE WHEN is_time THEN CASE WHEN question LIKE '%how long%' THEN '2b_elapsed' ELSE '2a_relative' END END AS time_kind, gold AS gold_original FROM f""")
def prj18(spark, sf_dir):
    k = F.col("k")
    rows = asked(spark, sf_dir).join(items(spark, sf_dir).select("event_id", "video"), "event_id")
    start, at = (F.col("t") % 5000).cast("double"), lambda s: questions.seconds_clock((F.col("t") % 5000 + s).cast("double"))
    gold = F.when(k % 4 == 0, F.concat_ws(", ", at(5), at(17))).when(k % 4 == 2, "00:00:12").otherwise((k % 9).cast("string"))
    row = questions.chat_row(
        SYSTEM, F.col("question"), gold, (k % 4).isin(0, 2), F.concat(F.lit("v"), "video"), start, (10 + k % 40).cast("double"), (4 + k % 5).cast("int"), (1 + k % 2).cast("int"), 2.0, F.lit(10_000).cast("long")
    )
    told = rows.select("event_id", row.alias("r"))
    text = lambda i: F.col("r.messages")[i]["content"]
    return told.select(
        "event_id", text(0).alias("system"), text(1).alias("asked"), text(2).alias("assistant"), F.array_join("r.videos", ",").alias("videos"), "r.raw_fps",
        F.col("r.meta.k").cast("long").alias("n_frames"), F.col("r.meta.k_fine"), F.col("r.meta.time_kind"), F.col("r.meta.gold_original"),
    )


MODELS = {"m20": 20, "m30": 30, "m40": 40, "m00": 0}


@query("agg15_policies", """WITH s AS (SELECT l_orderkey AS key, """ + ", ".join(f"coalesce(string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) FILTER (l_quantity > {q}), 'none') AS {m}" for m, q in {"gold": 10, **MODELS}.items()) + """ FROM lineitem GROUP BY l_orderkey),
    e AS (""" + " UNION ALL ".join([f"SELECT key, gold, '{m}' AS policy, {m} AS answer FROM s" for m in MODELS] + [f"SELECT key, gold, 'shorter_{a}_{b}', CASE WHEN len({b}) < len({a}) THEN {b} ELSE {a} END FROM s" for i, a in enumerate(MODELS) for b in list(MODELS)[i + 1 :]]) + """)
    SELECT policy, count(*) AS n, count(*) FILTER (answer = gold) AS n_right, round(avg((answer = gold)::INT), 6) AS accuracy FROM e GROUP BY policy""")
def agg15(spark, sf_dir):
    """Four readings of an order's flags and the shorter of each two, against one that is none of them; joined by key."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_returnflag", "l_quantity")

    def told(name: str, least: int):
        found = F.array_join(F.array_sort(F.collect_set(F.when(F.col("l_quantity") > least, F.col("l_returnflag")))), ", ")
        return lines.groupBy("key").agg(F.when(found == "", "none").otherwise(found).alias(name))

    wide = told("gold", 10)
    for name, least in MODELS.items():
        wide = wide.join(told(name, least), "key")
    return rounded(comparing.policies(wide, "key", "gold", list(MODELS)), "accuracy")


@query("prj08_first_of_aliases", f"""WITH {RAW}, f AS (SELECT event_id, regexp_replace(coalesce(nullif(text, ''), k::VARCHAR), '^\\s+|\\s+$', '', 'g') AS first FROM raw),
    n AS (SELECT event_id, CASE WHEN regexp_full_match(first, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') THEN try_cast(first AS DOUBLE) END AS num FROM f) SELECT event_id, num, trunc(num)::BIGINT AS whole FROM n""")
def prj08(spark, sf_dir):
    first = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("k").cast("string"))
    return raw_answers(spark, sf_dir).select("event_id", answers.as_number(first).alias("num"), answers.as_whole(first).alias("whole"))


@query("scl17_legality", f"""WITH {RAW}, b AS (SELECT event_id, fmt, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT event_id, fmt, CASE WHEN fmt = 'fo_class' THEN CASE event_id % 5 WHEN 0 THEN 'Click, view' WHEN 1 THEN 'error,  VIEW' WHEN 2 THEN ' , ' WHEN 3 THEN 'none' ELSE text END ELSE text END AS text FROM raw)),
    c AS (SELECT *, list_filter(list_transform(string_split(lower(t), ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM b),
    u AS (SELECT *, list_filter(parts, lambda x: x NOT IN ('click', 'error', 'view', 'none')) AS unknown FROM c),
    g AS (SELECT event_id, fmt, CASE WHEN t = '' THEN 'empty'
        WHEN fmt = 'number' THEN CASE WHEN regexp_matches(t, '^\\d+$') THEN 'ok' WHEN regexp_matches(t, '^\\d+\\s*\\.$') THEN 'trailing_period' WHEN regexp_matches(t, '^\\d+\\s*[a-zA-Z]') THEN 'number_plus_unit' WHEN regexp_matches(t, '^\\d+[.,]\\d+$') THEN 'decimal' WHEN regexp_matches(t, '\\d') THEN 'number_in_prose' ELSE 'no_digits' END
        WHEN fmt = 'binary' THEN CASE WHEN lower(t) IN ('yes', 'no') THEN 'ok' WHEN regexp_matches(t, '(?i)^(yes|no)\\b') THEN 'yesno_plus_text' ELSE 'not_yesno' END
        ELSE CASE WHEN len(parts) = 0 THEN 'empty' WHEN len(unknown) > 0 THEN 'unknown_class:' || left(unknown[1], 24) WHEN contains(t, '  ') THEN 'whitespace' ELSE 'ok' END END AS tag FROM u)
    SELECT fmt, tag, count(*) AS n, count(*) FILTER (tag = 'ok') AS legal FROM g GROUP BY ALL""")
def scl17(spark, sf_dir):
    shapes = F.array(*(F.lit(x) for x in ("Click, view", "error,  VIEW", " , ", "none")))
    text = F.when((F.col("fmt") == "fo_class") & (F.col("event_id") % 5 < 4), F.get(shapes, (F.col("event_id") % 5).cast("int"))).otherwise(F.col("text"))
    tagged = raw_answers(spark, sf_dir).select("fmt", answers.legality(text, F.col("fmt"), ["Click", "Error", "View"]).alias("l"))
    return tagged.groupBy("fmt", "l.tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("l.legal").alias("legal"))


@query("jon02_inner_template", f"""WITH {ITEMS}, l AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
    SELECT template, count(*) AS n, round(avg(l_quantity), 6) AS quantity FROM ev JOIN l ON event_id = l_orderkey AND rn = 1 WHERE regexp_matches(template, '^T[0-3]') GROUP BY template""")
def jon02(spark, sf_dir):
    """Of several results of a key the first one counts, and keys without a result drop out."""
    lines = joining.first_row(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select(F.col("l_orderkey").alias("event_id"), "l_quantity")
    rows = items(spark, sf_dir).filter(F.col("template").rlike("^T[0-3]")).join(lines, "event_id")
    return rounded(rows.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("quantity")), "quantity")


@query("jon08_prepared_answers", """SELECT d.doc_id, quality = 1 AS truth, CASE WHEN lang = 'en' THEN round(1.0 / (1 + abs(quality - toxic)), 6) END AS dice, n_chars < 2000 AS in_target FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def jon08(spark, sf_dir):
    """Documents are the items and labels the answers, which only some of them have."""
    rows, refs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), read(spark, sf_dir, "labels")
    joined = rows.join(refs, "doc_id")
    dice = F.when(F.col("lang") == "en", F.lit(1.0) / (1 + F.abs(F.col("quality") - F.col("toxic"))))
    return rounded(joined.select("doc_id", (F.col("quality") == 1).alias("truth"), dice.alias("dice"), (F.col("n_chars") < 2000).alias("in_target")), "dice")


@query("snk10_inspection_rows", "SELECT d.doc_id, quality AS correct, lang AS fmt, url AS our_answer, source AS ground_truth FROM documents d JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id")
def snk10(spark, sf_dir):
    """Items with a result, and the response where there is one; wrong ones first, in ranges."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("fmt"), F.col("source").alias("ground_truth"))
    results = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("correct"))
    responses = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("our_answer"))
    return rows.join(results, "doc_id").join(responses, "doc_id", "left").select("doc_id", "correct", "fmt", "our_answer", "ground_truth").orderBy("correct", "fmt", "doc_id")


@query("scl19_numbers_in_text", "WITH n AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(\\d{1,9})'), lambda x: x::INT), lambda x: x <= 500) AS v FROM documents) SELECT doc_id, len(v) AS n, list_last(v) AS last FROM n")
def scl19(spark, sf_dir):
    every = answers.numbers_in(F.coalesce("text", F.lit("")), 500)
    return read(spark, sf_dir, "documents").select("doc_id", every.alias("v")).select("doc_id", F.size("v").alias("n"), F.try_element_at("v", F.lit(-1)).alias("last"))
