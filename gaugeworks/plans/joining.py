"""Joins, set operations and gates over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.functions import sketches
from gaugeworks.operators import gates, joining
from gaugeworks.operators.resampling import written
from gaugeworks.plans.rounding import rounded
from gaugeworks.registry import query
from gaugeworks.sources.adapters import ITEMS, items, read


@query("jon01_left_first_gold", """WITH g AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
    SELECT c_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM customer LEFT JOIN g ON c_custkey = o_custkey AND rn = 1""")
def jon01(spark, sf_dir):
    gold = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    done = joining.left_first(read(spark, sf_dir, "customer").select("c_custkey"), gold, "c_custkey", ["o_orderdate", "o_orderkey"])
    return rounded(done.drop("o_orderdate"), "o_totalprice")


@query("jon03_delta_join", f"""WITH {ITEMS}, b AS (SELECT l_orderkey AS event_id, max((l_quantity > 25)::INT)::DOUBLE AS correct FROM lineitem GROUP BY l_orderkey)
    SELECT grp, count(*) AS n, round(avg(b.correct) - avg(ev.correct_a), 6) AS delta FROM ev JOIN b ON ev.event_id = b.event_id GROUP BY grp""")
def jon03(spark, sf_dir):
    rows = items(spark, sf_dir)
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.max((F.col("l_quantity") > 25).cast("double")).alias("correct"))
    a, b = rows.select("qid", F.col("correct_a").alias("correct")), rows.join(lines, "event_id").select("qid", "correct")
    done = joining.three_way(rows.select("qid", "grp"), a, b, "qid").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), (F.avg("correct_b") - F.avg("correct_a")).alias("delta"))
    return rounded(done, "delta")


@query("jon10_agreement", f"""WITH {ITEMS}, s AS (SELECT *, (answer = pred)::INT::DOUBLE AS s1, (k % 2)::DOUBLE AS s2 FROM ev)
    SELECT 's1' AS scorer, round(avg((s1 = correct_a)::INT), 6) AS agree, count(*) FILTER (s1 = 1 AND correct_a = 0) AS only_scorer, count(*) FILTER (s1 = 0 AND correct_a = 1) AS only_control FROM s
    UNION ALL SELECT 's2', round(avg((s2 = correct_a)::INT), 6), count(*) FILTER (s2 = 1 AND correct_a = 0), count(*) FILTER (s2 = 0 AND correct_a = 1) FROM s""")
def jon10(spark, sf_dir):
    rows = items(spark, sf_dir).select("correct_a", (F.col("answer") == F.col("pred")).cast("double").alias("s1"), (F.col("k") % 2).cast("double").alias("s2"))
    return rounded(joining.agreement(rows, "correct_a", ["s1", "s2"]), "agree")


@query("jon11_attach_intervals", """SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def jon11(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    per = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    joined = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("jon12_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jon12(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").join(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("jon13_against_base_cell", f"WITH {ITEMS}, c AS (SELECT dist, template, avg(correct_a) AS a FROM ev GROUP BY ALL), b AS (SELECT *, max(a) FILTER (template = 'T0') OVER (PARTITION BY dist) AS base FROM c) SELECT dist, template, round(a, 6) AS a, round(a - base, 6) AS over_base FROM b")
def jon13(spark, sf_dir):
    cells = items(spark, sf_dir).groupBy("dist", "template").agg(F.avg("correct_a").alias("a"))
    base = F.max(F.when(F.col("template") == "T0", F.col("a"))).over(Window.partitionBy("dist"))
    return rounded(cells.withColumn("over_base", F.col("a") - base), "a", "over_base")


#: A text of some hundred words with one word changed is nearly always so close (a test measures how often).
CLOSE_BITS = 8


@query("jon15_close_hashes")
def jon15(spark, sf_dir):
    sketched = read(spark, sf_dir, "documents").select("doc_id", sketches.simhash(sketches.shingle_hashes(F.col("text"))).alias("h"))
    docs = written(sketched, "sketches")  # once, as both sides and the summary read them
    return joining.close_summary(docs.filter("doc_id % 50 = 0"), docs, "doc_id", CLOSE_BITS)


@query("jon19_every_source", "SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def jon19(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    n = rows.select("event_type").distinct().count()
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n).select("user_id")


@query("snk16_upsert", "SELECT event_id, event_type FROM events UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)")
def snk16(spark, sf_dir):
    old = read(spark, sf_dir, "events").select("event_id", "event_type")
    return joining.upsert_missing(old, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("event_type")), ["event_id"])


@query("set01_unseen_templates", f"WITH {ITEMS} SELECT DISTINCT grp, k FROM ev WHERE dist = 'ID' AND (k) NOT IN (SELECT k FROM ev WHERE dist = 'OOD')")
def set01(spark, sf_dir):
    rows = items(spark, sf_dir)
    seen = rows.filter("dist = 'OOD'").select("k")
    return rows.filter("dist = 'ID'").select("grp", "k").distinct().join(seen, "k", "left_anti").select("grp", "k")


@query("set02_no_leak_gate", f"WITH {ITEMS} SELECT dist, count(DISTINCT qid) AS n FROM ev GROUP BY dist")
def set02(spark, sf_dir):
    rows = items(spark, sf_dir)
    gates.disjoint(rows.filter("dist = 'ID'"), rows.filter("dist = 'OOD'"), ["qid"])
    return gates.unique(rows, ["qid"]).groupBy("dist").agg(F.count_distinct("qid").alias("n"))


@query("set06_label_union", """SELECT l_orderkey AS key, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS labels, max((l_returnflag = 'A')::INT) AS has_a, max((l_returnflag = 'N')::INT) AS has_n, max((l_returnflag = 'R')::INT) AS has_r FROM lineitem GROUP BY l_orderkey""")
def set06(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("labels"),
        *(F.max((F.col("l_returnflag") == x).cast("int")).alias(f"has_{x.lower()}") for x in ("A", "N", "R")),
    )


@query("set09_sections", f"WITH {ITEMS} SELECT 'by_dist' AS section, dist, NULL AS fmt, count(*) AS n FROM ev GROUP BY dist UNION ALL SELECT 'by_format', NULL, fmt, count(*) FROM ev GROUP BY fmt")
def set09(spark, sf_dir):
    rows = items(spark, sf_dir)
    parts = [rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).withColumn("section", F.lit(s)) for c, s in (("dist", "by_dist"), ("fmt", "by_format"))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).select("section", "dist", "fmt", "n")


@query("set07_canonical_difference", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def set07(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.select("l_partkey", "l_suppkey").subtract(rows.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey"))


@query("gat06_unique_gate", "SELECT count(*) AS n FROM events")
def gat06(spark, sf_dir):
    return gates.unique(read(spark, sf_dir, "events"), ["event_id"]).agg(F.count(F.lit(1)).alias("n"))


@query("gat07_vocabulary_gate", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def gat07(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return gates.known_values(rows, "event_type", ["click", "error", "purchase", "signup", "view"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("gat14_identical_gate", "SELECT count(*) AS n_compared, count(*) AS n_equal FROM events")
def gat14(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "event_type")
    found = gates.identical(rows, rows.select("event_id", F.lower("event_type").alias("event_type")), "event_id", "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n_compared"), F.lit(found["n_equal"]).cast("long").alias("n_equal"))


@query("prj32_format_map", "SELECT o_custkey AS template, min(c_nationkey) AS fmt FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def prj32(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("fmt"))
    rows = read(spark, sf_dir, "orders").join(customers, "o_custkey").select(F.col("o_custkey").alias("template"), "fmt")
    return gates.functional(rows, "template", "fmt")
