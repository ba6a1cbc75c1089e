"""Further reports over items, label sets and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.functions import answers, questions
from gaugeworks.functions.draws import order_key, uniform
from gaugeworks.operators import comparing, gates, labelling, ranking, sampling, sequences
from gaugeworks.operators.ranges import place_within, running_totals
from gaugeworks.plans.rounding import rounded
from gaugeworks.plans.texts import FLAGS, SAMPLES, flag_texts, sample_rows
from gaugeworks.registry import query
from gaugeworks.sources.adapters import ITEMS, SCORED, SETS, items, order_sets, read, scored_documents


@query("agg11_typical_gap", f"WITH {ITEMS}, s AS (SELECT k % 2 = 0 AS typical, video, avg(correct_a) AS a FROM ev GROUP BY ALL) SELECT typical, count(*) AS n_videos, round(avg(a), 6) AS accuracy FROM s GROUP BY typical")
def agg11(spark, sf_dir):
    per = items(spark, sf_dir).groupBy((F.col("k") % 2 == 0).alias("typical"), "video").agg(F.avg("correct_a").alias("a"))
    return rounded(per.groupBy("typical").agg(F.count(F.lit(1)).alias("n_videos"), F.avg("a").alias("accuracy")), "accuracy")


@query("agg13_jackknife_f1", f"""WITH {SETS}, e AS (SELECT o_custkey AS part, gold, pred, unnest(list_distinct(list_concat(gold, pred))) AS class FROM os JOIN orders ON key = o_orderkey),
    c AS (SELECT part, class, count(*) FILTER (list_contains(gold, class) AND list_contains(pred, class)) AS tp, count(*) FILTER (NOT list_contains(gold, class) AND list_contains(pred, class)) AS fp, count(*) FILTER (list_contains(gold, class) AND NOT list_contains(pred, class)) AS fn FROM e GROUP BY ALL),
    l AS (SELECT class, 2 * (sum(tp) OVER w - tp) / (2 * (sum(tp) OVER w - tp) + sum(fp) OVER w - fp + sum(fn) OVER w - fn) AS f1 FROM c WINDOW w AS (PARTITION BY class))
    SELECT class, count(*) AS n_parts, round(min(f1), 6) AS lo, round(max(f1), 6) AS hi FROM l GROUP BY class""")
def agg13(spark, sf_dir):
    customers = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("part"))
    counts = labelling.class_counts(order_sets(spark, sf_dir).join(customers, "key"), ["part"])
    totals = counts.groupBy("class").agg(*(F.sum(c).alias(f"all_{c}") for c in ("tp", "fp", "fn")))
    tp, fp, fn = (F.col(f"all_{c}") - F.col(c) for c in ("tp", "fp", "fn"))
    left = counts.join(totals, "class").withColumn("f1", F.try_divide(2 * tp, 2 * tp + fp + fn))
    return rounded(left.groupBy("class").agg(F.count(F.lit(1)).alias("n_parts"), F.min("f1").alias("lo"), F.max("f1").alias("hi")), "lo", "hi")


@query("agg39_per_question", f"WITH {SAMPLES} SELECT key, len(c) AS k, list_sum(c) AS n_correct, len(list_distinct(c)) <= 1 AS zero_advantage, list_max(c) = 1 AS passed, c[1] = 1 AS greedy FROM k")
def agg39(spark, sf_dir):
    c = F.col("c")
    return sample_rows(spark, sf_dir).select(
        "key", F.size(c).alias("k"), F.size(F.filter(c, lambda x: x)).alias("n_correct"), (F.size(F.array_distinct(c)) <= 1).alias("zero_advantage"), F.exists(c, lambda x: x).alias("passed"), c[0].alias("greedy")
    )


@query("agg41_by_temperature", f"WITH {SAMPLES}, t AS (SELECT key % 5 AS temperature, v[1] AS greedy, list_max(v) AS vote, key % 3 AS truth FROM k) SELECT temperature, count(*) AS n, round(avg((greedy = truth)::INT), 6) AS greedy_acc, round(avg((vote = truth)::INT), 6) AS vote_acc, round(avg((abs(vote - truth) < abs(greedy - truth))::INT), 6) AS closer, round(avg((abs(vote - truth) > abs(greedy - truth))::INT), 6) AS farther FROM t GROUP BY temperature")
def agg41(spark, sf_dir):
    rows = sample_rows(spark, sf_dir).select((F.col("key") % 5).alias("temperature"), F.col("v")[0].alias("greedy"), F.array_max("v").alias("vote"), (F.col("key") % 3).alias("truth"))
    near, far = F.abs(F.col("vote") - F.col("truth")), F.abs(F.col("greedy") - F.col("truth"))
    mean = lambda c: F.avg(c.cast("double"))
    done = rows.groupBy("temperature").agg(
        F.count(F.lit(1)).alias("n"), mean(F.col("greedy") == F.col("truth")).alias("greedy_acc"), mean(F.col("vote") == F.col("truth")).alias("vote_acc"), mean(near < far).alias("closer"), mean(near > far).alias("farther")
    )
    return rounded(done, "greedy_acc", "vote_acc", "closer", "farther")


@query("agg47_permutation_null", f"""WITH {SCORED}, b AS (SELECT doc_id, lang, score, quality, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM dl),
    q AS (SELECT lang, p, quality, row_number() OVER (PARTITION BY lang, p ORDER BY md5('47|perm|' || p || '|' || doc_id), doc_id) AS i FROM b, (SELECT unnest(range(20)) AS p)),
    r AS (SELECT b.lang, p, q.quality, rank() OVER (PARTITION BY b.lang, p ORDER BY score) + (count(*) OVER (PARTITION BY b.lang, p, score) - 1) / 2 AS k FROM b JOIN q ON b.lang = q.lang AND b.i = q.i),
    s AS (SELECT lang, p, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality <> 1) AS n0, sum(k) FILTER (quality = 1) AS s FROM r GROUP BY ALL),
    a AS (SELECT lang, (s - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0) AS auc FROM s)
    SELECT lang, count(auc) AS draws, round(avg(auc), 6) AS mean, round(stddev_samp(auc), 6) AS sd, round(max(auc), 6) AS most FROM a GROUP BY lang""")
def agg47(spark, sf_dir):
    base = scored_documents(spark, sf_dir).select("doc_id", "lang", "score", "quality")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    numbered = base.withColumn("i", place)
    spread = base.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(19))))
    drawn = spread.select("lang", "p", "quality", F.row_number().over(Window.partitionBy("lang", "p").orderBy(order_key(47, "perm", F.col("p"), F.col("doc_id")), "doc_id")).alias("i"))
    paired = numbered.select("lang", "i", "score").join(drawn, ["lang", "i"])
    done = ranking.auc(paired, ["lang", "p"], "score", F.col("quality") == 1)
    return rounded(done.groupBy("lang").agg(F.count("auc").alias("draws"), F.avg("auc").alias("mean"), F.stddev_samp("auc").alias("sd"), F.max("auc").alias("most")), "mean", "sd", "most")


@query("agg50_frame_maximum_gaps", f"""WITH {ITEMS}, f AS (SELECT video, t // 600 AS frame, max(answer) AS most FROM ev GROUP BY ALL), d AS (SELECT video, frame - lag(frame) OVER w AS gap, abs(most - lag(most) OVER w) AS jump FROM f WINDOW w AS (PARTITION BY video ORDER BY frame))
    SELECT count(*) AS n, round(avg(gap), 6) AS mean_gap, round(avg(jump), 6) AS mean_jump, max(jump) AS max_jump FROM d WHERE gap IS NOT NULL""")
def agg50(spark, sf_dir):
    frames = items(spark, sf_dir).groupBy("video", F.floor(F.col("t") / 600).alias("frame")).agg(F.max("answer").alias("most"))
    order = Window.partitionBy("video").orderBy("frame")
    d = frames.select((F.col("frame") - F.lag("frame").over(order)).alias("gap"), F.abs(F.col("most") - F.lag("most").over(order)).alias("jump")).filter("gap is not null")
    return rounded(d.agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.avg("jump").alias("mean_jump"), F.max("jump").alias("max_jump")), "mean_gap", "mean_jump")


@query("agg64_containment", f"WITH {SETS} SELECT round(avg((len(list_filter(gold, lambda x: NOT list_contains(pred, x))) = 0)::INT), 6) AS contained, round(avg(len(pred)), 6) AS mean_size, count(*) AS n FROM os")
def agg64(spark, sf_dir):
    inside = (F.size(F.array_except("gold", "pred")) == 0).cast("double")
    return rounded(order_sets(spark, sf_dir).agg(F.avg(inside).alias("contained"), F.avg(F.size("pred")).alias("mean_size"), F.count(F.lit(1)).alias("n")), "contained", "mean_size")


@query("agg66_rates_by_band", f"""WITH {ITEMS}, f AS (SELECT *, min(t) FILTER (grp = 'error') OVER (PARTITION BY video) AS f FROM ev), b AS (SELECT CASE WHEN f - t <= 3600 THEN '1h' WHEN f - t <= 86400 THEN '1d' ELSE 'more' END AS band, correct_a FROM f WHERE t < f)
    SELECT band, count(*) AS n, round(avg((correct_a = 0)::INT), 6) AS rate FROM b GROUP BY band""")
def agg66(spark, sf_dir):
    before = sequences.before_first_event(items(spark, sf_dir), "video", "t", F.col("grp") == "error")
    gap = F.col("first_event") - F.col("t")
    band = F.when(gap <= 3600, "1h").when(gap <= 86400, "1d").otherwise("more")
    return rounded(before.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("correct_a") == 0).cast("double")).alias("rate")), "rate")


@query("agg69_discordant_templates", f"""WITH {ITEMS}, f AS (SELECT video, max(answer) FILTER (template = 'T0') AS a, max(answer) FILTER (template = 'T1') AS b FROM ev GROUP BY video), j AS (SELECT ev.template, f.a <> f.b AS discordant FROM ev JOIN f USING (video) WHERE a IS NOT NULL AND b IS NOT NULL),
    c AS (SELECT discordant, template, count(*) AS n FROM j GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY discordant ORDER BY n DESC, template) AS rn FROM c) SELECT discordant, template, n FROM o WHERE rn <= 4""")
def agg69(spark, sf_dir):
    rows = items(spark, sf_dir)
    of = lambda t: F.max(F.when(F.col("template") == t, F.col("answer")))
    frames = rows.groupBy("video").agg(of("T0").alias("a"), of("T1").alias("b")).filter("a is not null and b is not null").select("video", (F.col("a") != F.col("b")).alias("discordant"))
    counted = rows.join(frames, "video").groupBy("discordant", "template").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("discordant").orderBy(F.desc("n"), "template"))
    return counted.withColumn("rn", place).filter("rn <= 4").drop("rn")


@query("agg71_trace_lengths", "SELECT role, count(*) AS n, count(*) FILTER (text IS NULL OR text = '') AS empty, round(avg(length(text)), 6) AS mean_length, max(length(text)) AS max_length FROM conversations GROUP BY role")
def agg71(spark, sf_dir):
    done = read(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty"), F.avg(F.length("text")).alias("mean_length"), F.max(F.length("text")).alias("max_length")
    )
    return rounded(done, "mean_length")


@query("agg72_interval_overlap", f"WITH {ITEMS}, c AS (SELECT grp, avg(correct_a) - 0.02 AS lo, avg(correct_a) + 0.02 AS hi FROM ev GROUP BY grp) SELECT a.grp AS a, b.grp AS b, a.lo <= b.hi AND b.lo <= a.hi AS overlap FROM c a JOIN c b ON a.grp < b.grp")
def agg72(spark, sf_dir):
    c = items(spark, sf_dir).groupBy("grp").agg((F.avg("correct_a") - 0.02).alias("lo"), (F.avg("correct_a") + 0.02).alias("hi"))
    a, b = c.alias("a"), c.alias("b")
    joined = a.join(F.broadcast(b), F.col("a.grp") < F.col("b.grp"))
    return joined.select(F.col("a.grp").alias("a"), F.col("b.grp").alias("b"), ((F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi"))).alias("overlap"))


@query("scl07_vote_classes", "WITH s AS (SELECT l_orderkey AS key, list(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey), w AS (SELECT key, list_filter(['A', 'N', 'R'], lambda c: len(list_filter(f, lambda x: x = c)) >= 2) AS won FROM s) SELECT key, CASE WHEN len(won) = 0 THEN 'None' ELSE array_to_string(won, ', ') END AS voted FROM w")
def scl07(spark, sf_dir):
    sets = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_list(F.array("l_returnflag")).alias("sets"))
    return sets.select("key", answers.vote_classes(F.col("sets"), ["A", "N", "R"], 2).alias("voted"))


@query("scl10_loose_class_set", f"WITH {FLAGS} SELECT key, CASE key % 5 WHEN 0 THEN NULL WHEN 1 THEN 'none' WHEN 2 THEN NULL ELSE a END AS found FROM s")
def scl10(spark, sf_dir):
    listed = F.concat(F.replace(F.col("a"), F.lit(", "), F.lit(" and ")), F.lit("."))
    loose = F.when(F.col("key") % 5 == 0, "no").when(F.col("key") % 5 == 1, " No foreign objects. ").when(F.col("key") % 5 == 2, F.concat(listed, F.lit("; q"))).otherwise(listed)
    return flag_texts(spark, sf_dir).select("key", answers.join_set(answers.loose_class_set(loose, ["A", "N", "R"])).alias("found"))


@query("scl25_classes_by_position", "SELECT p_partkey, array_to_string(list_transform(list_sort(list_filter([{'i': instr(lower(p_type), 'steel'), 'c': 'steel'}, {'i': instr(lower(p_type), 'promo'), 'c': 'promo'}, {'i': instr(lower(p_type), 'small'), 'c': 'small'}], lambda x: x.i > 0)), lambda x: x.c), ',') AS classes FROM part")
def scl25(spark, sf_dir):
    at = F.array(*(F.struct(F.instr(F.lower("p_type"), c).alias("i"), F.lit(c).alias("c")) for c in ("steel", "promo", "small")))
    found = F.transform(F.array_sort(F.filter(at, lambda x: x["i"] > 0)), lambda x: x["c"])
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("classes"))


@query("prj02_leaf_groups", f"WITH {ITEMS} SELECT qid, CASE k % 5 WHEN 0 THEN 'object_recognition' WHEN 1 THEN 'temporal_grounding' WHEN 2 THEN 'aggregation' WHEN 3 THEN 'event_understanding' ELSE 'complex_reasoning' END AS grp FROM ev")
def prj02(spark, sf_dir):
    leaf = F.concat((F.col("k") % 5 + 1).cast("string"), F.substring(F.lit("abcde"), (F.col("event_id") % 5 + 1).cast("int"), F.lit(1)))
    rows = items(spark, sf_dir).select("qid", questions.leaf_group(leaf).alias("grp"))
    return gates.every_leaf_has_group(rows, F.col("grp"))


@query("prj20_shift_clock", f"""WITH {ITEMS}, c AS (SELECT event_id, k, t % 86400 AS s, t % 86400 + k * 60 AS m, k * 60 + 7 AS x FROM ev)
    SELECT event_id, CASE WHEN k % 4 = 0 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) || ', soon'
        ELSE printf('%02d:%02d:%02d', m // 3600, m % 3600 // 60, m % 60) || ', ' || printf('%02d:%02d:%02d', x // 3600, x % 3600 // 60, x % 60) END AS moved FROM c""")
def prj20(spark, sf_dir):
    rows = items(spark, sf_dir).join(read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("clock")), "event_id")
    told = F.concat(F.col("clock"), F.lit(", "), F.when(F.col("k") % 4 == 0, "soon").otherwise("00:00:07"))
    return rows.select("event_id", questions.shift_clock(told, F.col("k") * 60.0).alias("moved"))


@query("prj24_strip_premise", f"""WITH {ITEMS} SELECT event_id, CASE k % 3 WHEN 0 THEN 'Which ' || grp || ' of ' || k || '?' WHEN 1 THEN 'There are ' || k || ' of ' || grp || '.' ELSE 'Is ' || grp || ' there?' END AS question FROM ev""")
def prj24(spark, sf_dir):
    of = lambda *parts: F.concat(*(F.lit(p) if p[0].isupper() or not p[0].isalpha() else F.col(p).cast("string") for p in parts))
    premise, asked = of("There are ", "k", " of ", "grp", "."), of("Which ", "grp", " of ", "k", "?")
    told = F.when(F.col("k") % 3 == 0, F.concat(premise, F.lit(" There is more! "), asked)).when(F.col("k") % 3 == 1, premise).otherwise(of("Is ", "grp", " there?"))
    return items(spark, sf_dir).select("event_id", questions.strip_leading(told, "There (is|are)").alias("question"))


@query("prj22_first_words", "SELECT array_to_string(string_split_regex(trim(text), '\\s+')[1:2], ' ') AS head, count(*) AS n FROM benchmark GROUP BY 1")
def prj22(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").groupBy(questions.first_words(F.col("text"), 2).alias("head")).agg(F.count(F.lit(1)).alias("n"))


@query("jon07_flip_frame", f"WITH {ITEMS} SELECT qid, correct_a > correct_b AS lost, correct_b > correct_a AS won FROM ev WHERE correct_a <> correct_b")
def jon07(spark, sf_dir):
    rows = items(spark, sf_dir)
    pairs = comparing.pair_arms(rows.select("qid", F.col("correct_a").alias("correct")), rows.select("qid", F.col("correct_b").alias("correct")))
    return pairs.filter("correct_a <> correct_b").select("qid", (F.col("correct_a") > F.col("correct_b")).alias("lost"), (F.col("correct_b") > F.col("correct_a")).alias("won"))


@query("jon16_rank_matched", f"""WITH {ITEMS}, p AS (SELECT qid, CASE WHEN correct_a = 1 THEN 'J' ELSE 'S' END AS arm, floor(value / 50)::BIGINT AS bin, value FROM ev WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY bin, arm ORDER BY value, qid) AS place FROM p)
    SELECT j.bin, j.place, j.qid AS "key_J", s.qid AS "key_S" FROM r j JOIN r s ON j.bin = s.bin AND j.place = s.place WHERE j.arm = 'J' AND s.arm = 'S'""")
def jon16(spark, sf_dir):
    rows = items(spark, sf_dir).filter("value is not null").select("qid", F.when(F.col("correct_a") == 1, "J").otherwise("S").alias("arm"), "value")
    return sampling.rank_matched(rows, "arm", F.floor(F.col("value") / 50), "qid", "value")


@query("smp12_whole_groups_to_budget", f"""WITH {ITEMS}, s AS (SELECT video, count(*) AS n, md5('12|g|' || video) AS o FROM ev GROUP BY video), r AS (SELECT video, n, sum(n) OVER (ORDER BY o, video) AS running FROM s) SELECT video, n FROM r WHERE running <= 500""")
def smp12(spark, sf_dir):
    sizes = items(spark, sf_dir).groupBy("video").agg(F.count(F.lit(1)).alias("n"))
    hashed = sizes.withColumn("o", order_key(12, "g", F.col("video")))
    return running_totals(hashed, ["o", "video"], {"running": "n"}).filter("running <= 500").select("video", "n")


@query("smp23_every_kth", f"WITH {ITEMS}, n AS (SELECT qid, dist, row_number() OVER (PARTITION BY dist ORDER BY qid) AS rn FROM ev) SELECT qid, dist FROM n WHERE (rn - 1) % 25 = 0")
def smp23(spark, sf_dir):
    return place_within(items(spark, sf_dir).select("qid", "dist"), ["dist"], ["qid"], "rn").filter("(rn - 1) % 25 = 0").select("qid", "dist")


@query("gat04_bucket_counts_gate", f"WITH {ITEMS} SELECT grp, dist, count(*) AS n FROM ev GROUP BY ALL")
def gat04(spark, sf_dir):
    rows = items(spark, sf_dir)
    counted = rows.groupBy("grp", "dist").agg(F.count(F.lit(1)).alias("n"))
    source = read(spark, sf_dir, "events").groupBy("event_type").count().collect()  # a cell for each group
    expected = {(r[0], "OOD" if r[0] in ("error", "purchase") else "ID"): r[1] for r in source}
    gates.counts_are(rows, ["grp", "dist"], expected)
    return counted


@query("gat11_error_share_gate", "SELECT count(*) AS n FROM events")
def gat11(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return gates.share_at_most(rows, "events without a type", F.col("event_type").isNull(), 0.01).agg(F.count(F.lit(1)).alias("n"))


@query("gat18_rates_gate", f"WITH {ITEMS} SELECT count(*) FILTER (('0x' || substr(md5('18|r|' || qid), 1, 8))::UBIGINT / 4294967296.0 < 0.4) AS n FROM ev")
def gat18(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("flag", uniform(18, "r", F.col("qid")) < 0.4)
    return gates.rates_are(rows, {"flag": 0.4}, 0.05).agg(F.count_if("flag").alias("n"))
