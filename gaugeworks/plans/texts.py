"""Answer readers, question routing and time arithmetic, over texts made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import answers, questions
from gaugeworks.plans.rounding import rounded
from gaugeworks.registry import query
from gaugeworks.sources import chat
from gaugeworks.sources.adapters import ITEMS, items, read

#: Shapes of answers, by event number; the same list in both dialects.
SHAPES = (
    "{k}", "{k}.", "about {k} items", "three of them", "Yes.", "none", "no idea", "{k} clips and {j}", " {k} ", "counts: {k}", "",
    "{k} .", "No .", "Yes", "1:02:0{j}.", "10:02:00, 1:02:0{j} .", "00{k}", "count: {k}, {j}", '{"counts": "0{k}"', "NO", "1:02:0{j}",
)


def raw_answers(spark, sf_dir):
    shape = F.element_at(F.array(*(F.lit(s) for s in SHAPES)), (F.col("event_id") % len(SHAPES) + 1).cast("int"))
    text = F.replace(F.replace(shape, F.lit("{k}"), F.col("k").cast("string")), F.lit("{j}"), (F.col("k") % 5).cast("string"))
    return items(spark, sf_dir).select("event_id", "k", "fmt", "grp", "value", text.alias("text"))


RAW = f"""{ITEMS}, raw AS (SELECT event_id, k, fmt, grp, value, replace(replace([{", ".join(f"'{s}'" for s in SHAPES)}][event_id % {len(SHAPES)} + 1], '{{k}}', k::VARCHAR), '{{j}}', (k % 5)::VARCHAR) AS text FROM ev)"""
WORDS = "CASE w {} END".format(" ".join(f"WHEN '{w}' THEN {v}" for w, v in answers.NUMBER_WORDS.items()))


@query("scl01_parse_number", f"""WITH {RAW}, p AS (SELECT event_id, nullif(regexp_extract(text, '(\\d+)', 1), '')::DOUBLE AS d, regexp_extract(lower(text), '\\b({"|".join(answers.NUMBER_WORDS)})\\b', 1) AS w FROM raw)
    SELECT event_id, coalesce(d, {WORDS}) AS number FROM p""")
def scl01(spark, sf_dir):
    return raw_answers(spark, sf_dir).select("event_id", answers.parse_number(F.col("text")).alias("number"))


@query("scl02_normalise_answer", f"""WITH {RAW}, b AS (SELECT event_id, trim(text) AS t FROM raw)
    SELECT event_id, CASE WHEN regexp_full_match(t, '\\d+\\s*[.]') OR regexp_full_match(t, '\\d{{1,2}}:\\d{{2}}:\\d{{2}}(\\s*,\\s*\\d{{1,2}}:\\d{{2}}:\\d{{2}})*\\s*[.]') THEN rtrim(rtrim(t, '.'))
        WHEN regexp_full_match(lower(t), '(yes|no)\\s*[.]') THEN lower(rtrim(rtrim(t, '.'))) ELSE t END AS answer FROM b""")
def scl02(spark, sf_dir):
    return raw_answers(spark, sf_dir).select("event_id", answers.normalise_answer(F.col("text")).alias("answer"))


@query("scl03_read_count", f"WITH {RAW} SELECT event_id, nullif(regexp_extract(text, '^\\s*(\\d+)', 1), '')::DOUBLE AS n FROM raw")
def scl03(spark, sf_dir):
    return raw_answers(spark, sf_dir).select("event_id", answers.read_count(F.col("text")).alias("n"))


@query("scl05_key_binary", f"WITH {RAW} SELECT event_id, CASE WHEN regexp_matches(lower(trim(text)), '^(yes|true)($|[ ,.])') THEN 'yes' WHEN regexp_matches(lower(trim(text)), '^(no|false)($|[ ,.])') THEN 'no' END AS answer FROM raw")
def scl05(spark, sf_dir):
    return raw_answers(spark, sf_dir).select("event_id", answers.key_binary(F.col("text")).alias("answer"))


@query("scl13_parse_count", f"""WITH {RAW}, p AS (SELECT event_id, nullif(regexp_extract(text, '^\\s*(\\d+)\\s*$', 1), '') AS bare, nullif(regexp_extract(text, '(?i)["'']?counts["'']?\\s*:\\s*["'']?(\\d+)', 1), '') AS told, regexp_extract_all(text, '(\\d+)') AS every FROM raw)
    SELECT event_id, coalesce(bare, told, CASE WHEN len(every) = 1 THEN every[1] END, '0')::BIGINT::VARCHAR AS answer, CASE WHEN bare IS NOT NULL THEN 'bare_int' WHEN told IS NOT NULL THEN 'structured' WHEN len(every) = 1 THEN 'salvaged' ELSE 'malformed' END AS status FROM p""")
def scl13(spark, sf_dir):
    return raw_answers(spark, sf_dir).select("event_id", answers.parse_count(F.col("text")).alias("p")).select("event_id", "p.answer", "p.status")


FLAGS = "s AS (SELECT l_orderkey AS key, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS a, coalesce(string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) FILTER (WHERE l_quantity > 30), 'none') AS b FROM lineitem GROUP BY l_orderkey)"


def flag_texts(spark, sf_dir):
    some = F.array_join(F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 30, F.col("l_returnflag")))), ", ")
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), ", ").alias("a"), F.when(some == "", "none").otherwise(some).alias("b")
    )


@query("scl04_read_class_set", f"""WITH {FLAGS} SELECT key, CASE WHEN b = 'none' THEN CASE WHEN key % 7 = 0 THEN NULL ELSE 'None' END WHEN key % 5 = 0 OR key % 7 = 0 THEN NULL ELSE b END AS found FROM s""")
def scl04(spark, sf_dir):
    more = F.when(F.col("key") % 7 == 0, ", q").when(F.col("key") % 5 == 0, ", NONE").otherwise("")  # an unknown class; none among others
    return flag_texts(spark, sf_dir).select("key", answers.join_set(answers.read_class_set(F.concat(F.lower("b"), more), ["A", "N", "R"])).alias("found"))


@query("scl09_clamp_classes", f"""WITH {FLAGS}, l AS (SELECT key, b, list_filter(string_split(b, ', '), lambda x: x IN ('A', 'N')) AS known FROM s)
    SELECT key, CASE WHEN len(known) = 0 THEN 'Q, ' || b || ', none' ELSE array_to_string(known, ', ') END AS kept FROM l""")
def scl09(spark, sf_dir):
    noisy = F.concat(F.lit("Q, "), F.col("b"), F.lit(", none"))
    return flag_texts(spark, sf_dir).select("key", answers.clamp_classes(noisy, ["A", "N"]).alias("kept"))  # R is unknown here


@query("scl11_arbitrate", f"""WITH {FLAGS}, z AS (SELECT key, a, CASE WHEN b = 'none' THEN 0 ELSE len(string_split(b, ', ')) END AS nb, b, len(string_split(a, ', ')) AS na FROM s)
    SELECT key, CASE WHEN nb < na THEN b ELSE a END AS answer, nb < na AS changed FROM z""")
def scl11(spark, sf_dir):
    answer, changed = answers.arbitrate(F.col("a"), F.col("b"), ["A", "N", "R"])
    return flag_texts(spark, sf_dir).select("key", answer.alias("answer"), changed.alias("changed"))


@query("scl20_count_items", f"WITH {FLAGS} SELECT key, len(string_split(a, ', ')) AS n, len(list_distinct(string_split(lower(a || ', ' || a), ', '))) AS n_distinct FROM s")
def scl20(spark, sf_dir):
    twice = F.concat_ws(", ", "a", "a")
    return flag_texts(spark, sf_dir).select("key", answers.count_items(F.concat("a", F.lit("\nmore, parts"))).alias("n"), F.size(F.array_distinct(F.split(answers.comparison_key(twice), ","))).alias("n_distinct"))


SAMPLES = "k AS (SELECT l_orderkey AS key, list(l_linenumber % 3 ORDER BY l_linenumber) AS v, list((l_quantity > 25)::INT ORDER BY l_linenumber, l_quantity > 25) AS c FROM lineitem GROUP BY l_orderkey)"


def sample_rows(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_linenumber") % 3).alias("v"), (F.col("l_quantity") > 25).alias("c"))))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(ordered.alias("x")).select("key", F.transform("x", lambda x: x["v"]).alias("v"), F.transform("x", lambda x: x["c"]).alias("c"))


@query("scl06_vote_number", f"WITH {SAMPLES}, u AS (SELECT key, unnest(v) AS x FROM k), n AS (SELECT key, x, count(*) AS c FROM u GROUP BY ALL) SELECT key, arg_max(x, c * 100 - x) AS voted FROM n GROUP BY key")
def scl06(spark, sf_dir):
    return sample_rows(spark, sf_dir).select("key", answers.mode_lowest(F.col("v")).alias("voted"))


@query("agg37_diversity", f"""WITH {SAMPLES}, u AS (SELECT key, unnest(v) AS x FROM k), n AS (SELECT key, x, count(*) AS c FROM u GROUP BY ALL), t AS (SELECT key, sum(c) AS t FROM n GROUP BY key)
    SELECT key, count(*) AS n_unique, round(sum(-c / t * log2(c / t)), 6) AS entropy, round(max(c / t), 6) AS mode_share FROM n JOIN t USING (key) GROUP BY key""")
def agg37(spark, sf_dir):
    v = F.col("v")
    shares = F.transform(F.array_distinct(v), lambda x: F.size(F.filter(v, lambda y: y == x)) / F.size(v))
    entropy = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return rounded(sample_rows(spark, sf_dir).select("key", F.size(F.array_distinct(v)).cast("long").alias("n_unique"), entropy.alias("entropy"), F.array_max(shares).alias("mode_share")), "entropy", "mode_share")


@query("agg38_advantage_pass", f"WITH {SAMPLES} SELECT len(c) AS k, count(*) AS n, count(*) FILTER (len(list_distinct(c)) <= 1) AS zero_advantage, count(*) FILTER (list_max(c) = 1) AS passed FROM k GROUP BY len(c)")
def agg38(spark, sf_dir):
    c = F.col("c")
    return sample_rows(spark, sf_dir).groupBy(F.size(c).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size(F.array_distinct(c)) <= 1).alias("zero_advantage"), F.count_if(F.exists(c, lambda x: x)).alias("passed")
    )


@query("agg40_headroom_by_format", f"WITH {SAMPLES} SELECT key % 4 AS fmt, count(*) AS n, round(avg(list_max(c)), 6) AS pass_at_k, round(avg(c[1]), 6) AS greedy, round(avg(list_max(c)) - avg(c[1]), 6) AS headroom FROM k GROUP BY key % 4")
def agg40(spark, sf_dir):
    passed, greedy = F.avg(F.exists("c", lambda x: x).cast("double")), F.avg(F.col("c")[0].cast("double"))
    done = sample_rows(spark, sf_dir).groupBy((F.col("key") % 4).alias("fmt")).agg(F.count(F.lit(1)).alias("n"), passed.alias("pass_at_k"), greedy.alias("greedy"), (passed - greedy).alias("headroom"))
    return rounded(done, "pass_at_k", "greedy", "headroom")


@query("prj01_template_of", "SELECT event_type || ' at <TS> for ' || user_id AS template, count(*) AS n FROM events GROUP BY 1")
def prj01(spark, sf_dir):
    question = F.concat(F.col("event_type"), F.lit(" at "), F.date_format("ts", "HH:mm:ss"), F.lit(" for "), F.col("user_id").cast("string"))
    return read(spark, sf_dir, "events").groupBy(questions.template_of(question).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query("prj19_clock_round_trip", "SELECT event_id, printf('%02d:%02d:%02d', round_even(abs(value), 0)::BIGINT // 3600, round_even(abs(value), 0)::BIGINT % 3600 // 60, round_even(abs(value), 0)::BIGINT % 60) AS clock, round_even(abs(value), 0) AS seconds FROM events")
def prj19(spark, sf_dir):
    clock = questions.seconds_clock(F.abs("value"))
    return read(spark, sf_dir, "events").select("event_id", clock.alias("clock"), questions.clock_seconds(clock).alias("seconds"))


@query("prj15_frame_grid", """WITH d AS (SELECT event_id, 1.0::DOUBLE + event_id % 50 AS dur, event_id % 2 = 0 AS routed FROM events), k AS (SELECT *, least(5.0::DOUBLE, 1.0::DOUBLE + dur * 4.0::DOUBLE / 360.0::DOUBLE) AS thr FROM d)
    SELECT event_id, round(thr, 6) AS threshold, CASE WHEN routed THEN ceil(dur / thr)::INT + 1 ELSE 4 END AS frames FROM k""")
def prj15(spark, sf_dir):
    dur = F.lit(1.0) + F.col("event_id") % 50
    done = read(spark, sf_dir, "events").select("event_id", questions.threshold_seconds(dur).alias("threshold"), questions.frames_for(dur, F.col("event_id") % 2 == 0).alias("frames"))
    return rounded(done, "threshold")


@query("prj16_frame_indices", """WITH e AS (SELECT event_id, unnest(range(5)) AS i FROM events), g AS (SELECT event_id, i, least(round_even((event_id % 7 + (event_id % 3)::DOUBLE * i / 4) * 2.5, 0)::BIGINT, 20) AS f FROM e),
    d AS (SELECT event_id, f, min(i) AS i FROM g GROUP BY ALL) SELECT event_id, string_agg(f::VARCHAR, ',' ORDER BY i) AS frames FROM d GROUP BY event_id""")
def prj16(spark, sf_dir):
    frames = questions.frame_indices((F.col("event_id") % 7).cast("double"), (F.col("event_id") % 3).cast("double"), F.lit(5), 2.5, F.lit(21).cast("long"))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(frames, lambda x: x.cast("string")), ",").alias("frames"))


@query("prj31_count_prefix", f"WITH {FLAGS} SELECT key, len(string_split(a, ', ')) || ': ' || a AS told, len(string_split(a, ', ')) AS n, a AS bare FROM s")
def prj31(spark, sf_dir):
    told = questions.add_count_prefix(F.concat(F.lit("9: "), F.col("a")), answers.count_items(F.col("a")))
    return flag_texts(spark, sf_dir).select("key", told.alias("told"), questions.stated_count(told).alias("n"), questions.strip_count_prefix(told).alias("bare"))


@query("prj17_cache_names", "SELECT p_partkey, regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '__' || regexp_replace(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part")
def prj17(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", questions.cache_name(F.col("p_brand"), F.col("p_type")).alias("name"))


@query("prj26_swap_sides", f"""WITH {ITEMS}, w AS (SELECT event_id, ['top', 'Bottom', 'TOP', 'atop'][k % 4 + 1] AS v, ['left', 'RIGHT', 'Right', 'leftmost', 'Left'][event_id % 5 + 1] AS h FROM ev)
    SELECT event_id, v || '/' || CASE WHEN v = 'atop' THEN h WHEN h = 'left' THEN 'right' WHEN h = 'RIGHT' THEN 'LEFT' WHEN h = 'Right' THEN 'Left' WHEN h = 'Left' THEN 'Right' ELSE h END
        || ' not ' || v || '-' || h || ', bottom/left' AS flipped FROM w""")
def prj26(spark, sf_dir):
    v = F.element_at(F.array(*(F.lit(x) for x in ("top", "Bottom", "TOP", "atop"))), F.col("k") % 4 + 1)
    h = F.element_at(F.array(*(F.lit(x) for x in ("left", "RIGHT", "Right", "leftmost", "Left"))), (F.col("event_id") % 5 + 1).cast("int"))
    text = F.concat(v, F.lit("/"), h, F.lit(" not "), v, F.lit("-"), h, F.lit(", bottom/right"))
    return items(spark, sf_dir).select("event_id", questions.swap_sides(text).alias("flipped"))


@query("prj23_lexical_flags", "SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)\\bthe\\b')) AS with_the, round(avg(regexp_matches(text, '[0-9]')::INT), 6) AS digits FROM documents GROUP BY lang")
def prj23(spark, sf_dir):
    done = read(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").rlike(r"(?i)\bthe\b")).alias("with_the"), F.avg(F.col("text").rlike("[0-9]").cast("double")).alias("digits")
    )
    return rounded(done, "digits")


@query("scl24_tag_body", "SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')) AS title FROM pages")
def scl24(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", answers.tag_body(F.col("html"), "title").alias("title"))


@query("scl28_manifest_hash", """WITH h AS (SELECT sha256(c_name || chr(9) || c_nationkey) AS h FROM customer), b AS (SELECT substr(h, 1, 3) AS part, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1)
    SELECT sha256(string_agg(h, '' ORDER BY part)) AS digest FROM b""")
def scl28(spark, sf_dir):
    return chat.digest_of(read(spark, sf_dir, "customer"), ["c_name", "c_nationkey"])


@query("scl18_split_thinking", f"WITH {RAW} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE trim(text) END AS answer, event_id % 3 <> 0 AS closed FROM raw")
def scl18(spark, sf_dir):
    told = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("so "), "text")).otherwise(F.concat(F.lit("a</think>b</think>"), "text"))
    done = raw_answers(spark, sf_dir).select("event_id", answers.split_thinking(told).alias("s"))
    return done.select("event_id", "s.answer", "s.closed")
