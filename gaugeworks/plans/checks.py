"""Consistency reports and small selections over items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.functions import answers
from gaugeworks.functions.draws import order_key, uniform
from gaugeworks.operators import consistency
from gaugeworks.plans.rounding import rounded
from gaugeworks.plans.texts import RAW, raw_answers
from gaugeworks.registry import query
from gaugeworks.sources import readers
from gaugeworks.sources.adapters import ITEMS, items, read

TAGS = """b AS (SELECT grp, trim(text) AS t FROM raw WHERE fmt = 'number'), g AS (SELECT grp, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '^\\d+$') THEN 'ok' WHEN regexp_matches(t, '^\\d+\\s*\\.$') THEN 'trailing_period'
    WHEN regexp_matches(t, '^\\d+\\s*[a-zA-Z]') THEN 'number_plus_unit' WHEN regexp_matches(t, '^\\d+[.,]\\d+$') THEN 'decimal' WHEN regexp_matches(t, '\\d') THEN 'number_in_prose' ELSE 'no_digits' END AS tag FROM b),
    c AS (SELECT grp, tag, count(*) AS n FROM g GROUP BY ALL),
    v AS (SELECT grp, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (tag <> 'ok'), 0) / sum(n) AS rate FROM c GROUP BY grp),
    p AS (SELECT grp, tag, n, row_number() OVER (PARTITION BY grp ORDER BY n DESC, tag) AS rn FROM c WHERE tag <> 'ok')"""


def tagged(spark, sf_dir):
    rows = raw_answers(spark, sf_dir).filter("fmt = 'number'")
    return rows.select("grp", answers.legality(F.col("text"), F.col("fmt"), ["A"])["tag"].alias("tag"))


@query("agg61_violation_rates", f"WITH {RAW}, {TAGS} SELECT v.grp, v.n, round(rate, 6) AS illegal_rate, p.tag AS top_tag, p.n AS top_n FROM v LEFT JOIN p ON v.grp = p.grp AND rn = 1")
def agg61(spark, sf_dir):
    return rounded(consistency.violation_rates(tagged(spark, sf_dir), ["grp"], "tag"), "illegal_rate")


@query("agg61_regressions", f"WITH {RAW}, {TAGS} SELECT a.grp, round(a.rate, 6) AS illegal_rate, round(a.rate - b.rate, 6) AS rise FROM v a, v b WHERE b.grp = 'click' AND a.grp <> 'click' AND a.rate - b.rate >= 0")
def agg61_regressions(spark, sf_dir):
    rates = consistency.violation_rates(tagged(spark, sf_dir), ["grp"], "tag").withColumn("cell", F.lit("all"))
    done = consistency.regressions(rates, ["cell"], "grp", "click", "illegal_rate", 0.0)
    return rounded(done.select("grp", "illegal_rate", "rise"), "illegal_rate", "rise")


@query("agg62_presence_scores", f"""WITH {ITEMS}, d AS (SELECT fmt, count(*) AS n, avg(correct_a) FILTER (answer > 1) AS a, avg(correct_a) FILTER (answer <= 1) AS b FROM ev GROUP BY fmt)
    SELECT fmt, n, round(a, 6) AS rate_present, round(b, 6) AS rate_absent, round(coalesce(2 * a * (1 - b) / nullif(a + 1 - b, 0), 0), 6) AS harmonic FROM d""")
def agg62(spark, sf_dir):
    done = consistency.presence_scores(items(spark, sf_dir), ["fmt"], F.col("answer") > 1, F.col("correct_a"))
    return rounded(done, "rate_present", "rate_absent", "harmonic")


@query("agg65_known_state_f1", f"""WITH {ITEMS}, s AS (SELECT grp, CASE k % 3 WHEN 0 THEN 'PRESENT' WHEN 1 THEN 'ABSENT' ELSE 'UNKNOWN' END AS state, correct_b = 1 AS said FROM ev),
    c AS (SELECT grp, count(*) FILTER (state = 'PRESENT' AND said) AS tp, count(*) FILTER (state = 'ABSENT' AND said) AS fp, count(*) FILTER (state = 'PRESENT' AND NOT said) AS fn FROM s WHERE state <> 'UNKNOWN' GROUP BY grp)
    SELECT grp, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def agg65(spark, sf_dir):
    state = consistency.first_match([("PRESENT", F.col("k") % 3 == 0), ("ABSENT", F.col("k") % 3 == 1)], "UNKNOWN")
    done = consistency.known_state_f1(items(spark, sf_dir).withColumn("state", state), ["grp"], "state", F.col("correct_b") == 1)
    return rounded(done, "precision", "recall", "f1")


@query("agg67_stated_agreement", f"WITH {ITEMS} SELECT pred - answer AS delta, count(*) AS n FROM ev GROUP BY 1")
def agg67(spark, sf_dir):
    return consistency.stated_agreement(items(spark, sf_dir), "answer", "pred")


@query("agg68_sibling_totals", f"WITH {ITEMS}, f AS (SELECT video, sum(answer) FILTER (fmt = 'binary') AS parts, max(k) FILTER (fmt = 'number') AS total FROM ev GROUP BY video) SELECT video, parts::BIGINT AS parts, total, parts <= total AS fits FROM f WHERE parts IS NOT NULL AND total IS NOT NULL")
def agg68(spark, sf_dir):
    return consistency.sibling_totals(items(spark, sf_dir), "video", F.when(F.col("fmt") == "binary", F.col("answer")), F.when(F.col("fmt") == "number", F.col("k")))


@query("agg70_order_quantiles", f"WITH {ITEMS}, p AS (SELECT grp, k, row_number() OVER (PARTITION BY grp ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM ev) SELECT grp, max(n) AS n, max(k) FILTER (i = floor(n * 0.25)) AS q25, max(k) FILTER (i = floor(n * 0.5)) AS q50, max(k) FILTER (i = floor(n * 0.75)) AS q75 FROM p GROUP BY grp")
def agg70(spark, sf_dir):
    return consistency.order_quantiles(items(spark, sf_dir), ["grp"], "k", [0.25, 0.5, 0.75])


@query("add03_typicality", f"""WITH {ITEMS}, c AS (SELECT template, answer, count(*) AS n FROM ev WHERE dist = 'ID' GROUP BY ALL), m AS (SELECT template, arg_max(answer, n * 1000 - answer) AS typical FROM c GROUP BY template HAVING sum(n) >= 5)
    SELECT ev.answer = typical AS is_typical, count(*) AS n, round(avg(correct_a), 6) AS acc FROM ev JOIN m USING (template) WHERE dist = 'OOD' GROUP BY 1""")
def add03(spark, sf_dir):
    rows = items(spark, sf_dir)
    typical = consistency.modal_value(rows.filter("dist = 'ID'"), "template", "answer", 5)
    joined = rows.filter("dist = 'OOD'").join(typical, "template")
    return rounded(joined.groupBy((F.col("answer") == F.col("typical")).alias("is_typical")).agg(F.count(F.lit(1)).alias("n"), F.avg("correct_a").alias("acc")), "acc")


@query("add04_long_counts", f"WITH {ITEMS}, c AS (SELECT grp, fmt, template, count(*) AS n FROM ev GROUP BY ALL) SELECT *, sum(n) OVER (PARTITION BY grp)::BIGINT AS total, round(n / sum(n) OVER (PARTITION BY grp), 6) AS share FROM c")
def add04(spark, sf_dir):
    return rounded(consistency.long_counts(items(spark, sf_dir), ["grp", "fmt", "template"], "grp"), "share")


@query("add04_key_collisions", f"WITH {ITEMS} SELECT count(DISTINCT grp || '|' || video) AS pairs, count(DISTINCT video) AS keys, count(DISTINCT grp || '|' || video) - count(DISTINCT video) AS collisions FROM ev")
def add04_collisions(spark, sf_dir):
    return consistency.key_collisions(items(spark, sf_dir), "grp", "video")


@query("prj25_rule_cascade", f"WITH {ITEMS} SELECT CASE WHEN k % 11 = 0 THEN 'drop' WHEN fmt = 'number' AND k % 2 = 0 THEN 'rewrite' WHEN dist = 'OOD' THEN 'review' ELSE 'keep' END AS rule, fmt, count(*) AS n FROM ev GROUP BY ALL")
def prj25(spark, sf_dir):
    rule = consistency.first_match([("drop", F.col("k") % 11 == 0), ("rewrite", (F.col("fmt") == "number") & (F.col("k") % 2 == 0)), ("review", F.col("dist") == "OOD")], "keep")
    return items(spark, sf_dir).groupBy(rule.alias("rule"), "fmt").agg(F.count(F.lit(1)).alias("n"))


@query("prj27_exploded_matches", "SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]+)')) AS number FROM documents")
def prj27(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("number"))


@query("prj28_paraphrase_streams", f"""WITH {ITEMS}, u AS (SELECT event_id, ('0x' || substr(md5('42|stem|' || qid), 1, 8))::UBIGINT / 4294967296.0 < 0.5 AS stem, ('0x' || substr(md5('42|tail|' || qid), 1, 8))::UBIGINT / 4294967296.0 < 0.3 AS tail FROM ev)
    SELECT stem, tail, count(*) AS n FROM u GROUP BY ALL""")
def prj28(spark, sf_dir):
    rows = items(spark, sf_dir).select((uniform(42, "stem", F.col("qid")) < 0.5).alias("stem"), (uniform(42, "tail", F.col("qid")) < 0.3).alias("tail"))
    return rows.groupBy("stem", "tail").agg(F.count(F.lit(1)).alias("n"))


@query("src21_ordered_fallback", "SELECT o_custkey AS key, coalesce(min(o_orderkey) FILTER (o_orderkey % 7 = 0), min(o_orderkey) FILTER (o_orderkey % 3 = 0), min(o_orderkey)) AS value FROM orders GROUP BY o_custkey")
def src21(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    return readers.ordered_fallback([rows.filter("value % 7 = 0"), rows.filter("value % 3 = 0"), rows], "key", "value")


@query("smp22_shuffled_holdout", f"WITH {ITEMS}, n AS (SELECT qid, row_number() OVER (ORDER BY md5('22|e|' || qid), qid) AS p FROM ev WHERE fmt = 'number') SELECT qid FROM n WHERE p <= 50")
def smp22(spark, sf_dir):
    rows = items(spark, sf_dir).filter("fmt = 'number'").select("qid")
    return rows.orderBy(order_key(22, "e", F.col("qid")), "qid").limit(50)


@query("smp19_negatives_per_video", f"""WITH {ITEMS}, c AS (SELECT video, count(*) FILTER (correct_a = 1) AS pos FROM ev GROUP BY video), n AS (SELECT ev.video, qid, row_number() OVER (PARTITION BY ev.video ORDER BY md5('19|e|' || qid), qid) AS p FROM ev WHERE correct_a = 0)
    SELECT video, qid FROM n JOIN c USING (video) WHERE p <= round_even(pos * 0.5::DOUBLE, 0)""")
def smp19(spark, sf_dir):
    rows = items(spark, sf_dir).select("video", "qid", "correct_a")
    pos = F.count_if(F.col("correct_a") == 1).over(Window.partitionBy("video"))
    bad = rows.withColumn("pos", pos).filter("correct_a = 0")
    place = F.row_number().over(Window.partitionBy("video").orderBy(order_key(19, "e", F.col("qid")), "qid"))
    return bad.withColumn("p", place).filter(F.col("p") <= F.bround(F.col("pos") * F.lit(0.5), 0)).select("video", "qid")


@query("top09_shortest_of_candidates", "WITH s AS (SELECT l_orderkey AS key, list(DISTINCT l_returnflag) AS a, list(DISTINCT l_linestatus) AS b, list(DISTINCT l_linenumber) AS c FROM lineitem GROUP BY l_orderkey) SELECT key, least(len(a), len(b), len(c)) AS size, CASE WHEN len(a) <= len(b) AND len(a) <= len(c) THEN 'flags' WHEN len(b) <= len(c) THEN 'status' ELSE 'lines' END AS winner FROM s")
def top09(spark, sf_dir):
    sets = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(
        F.collect_set("l_returnflag").alias("flags"), F.collect_set("l_linestatus").alias("status"), F.collect_set(F.col("l_linenumber").cast("string")).alias("lines")
    )
    best = F.array_min(F.array(*(F.struct(F.size(c).alias("size"), F.lit(i).alias("i"), F.lit(c).alias("winner")) for i, c in enumerate(("flags", "status", "lines")))))
    return sets.select("key", best["size"].alias("size"), best["winner"].alias("winner"))
