"""Chat corpora, ledgers and feature models over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import features, gates
from gaugeworks.plans import ledger
from gaugeworks.plans.rounding import rounded
from gaugeworks.registry import query
from gaugeworks.sources import chat
from gaugeworks.sources.adapters import ITEMS, items, read


def chats(spark, sf_dir):
    return chat.chat_rows(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("snk14_chat_rows", "SELECT conv_id::VARCHAR AS key, string_agg(coalesce(role, '') || ':' || md5(coalesce(text, '')), '|' ORDER BY turn, role, text) AS body, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def snk14(spark, sf_dir):
    body = F.array_join(F.transform("messages", lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(":"), F.md5(F.coalesce(m["content"], F.lit(""))))), "|")
    return chats(spark, sf_dir).select("key", body.alias("body"), F.col("n_turns").cast("long").alias("n_turns"))


@query("src12_last_pair", "WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn FROM conversations) SELECT a.conv_id::VARCHAR AS key, b.text AS question, a.text AS answer FROM r a JOIN r b USING (conv_id) WHERE a.rn = 1 AND b.rn = 2")
def src12(spark, sf_dir):
    return chat.last_pair(chats(spark, sf_dir))


@query("prj30_rewrite_answers", "WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id::VARCHAR AS key, n AS n_turns, n || ': ' || text AS answer FROM r WHERE rn = 1")
def prj30(spark, sf_dir):
    rows = chats(spark, sf_dir)
    last = F.concat(F.col("n_turns").cast("string"), F.lit(": "), F.element_at("messages", -1)["content"])
    done = chat.rewrite_answers(rows, last)
    return done.select("key", F.size("messages").cast("long").alias("n_turns"), F.element_at("messages", -1)["content"].alias("answer"))


@query("gat16_round_trip_gate", "SELECT role, count(*) AS n FROM conversations GROUP BY role")
def gat16(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    packed = rows.select("role", "text", F.to_json(F.struct("text"), {"ignoreNullFields": "false"}).alias("line"))
    gates.round_trips(packed, F.from_json("line", "text string")["text"], "text")
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def _tier(threshold: int) -> str:
    return f"""SELECT 'e{threshold}' AS experiment, avg(a) AS bucket_mean FROM (SELECT grp, dist, avg(correct_a) AS a FROM ev WHERE k >= {threshold} GROUP BY ALL HAVING count(*) >= 2)"""


@query("snk06_ledger", f"WITH {ITEMS} SELECT experiment, round(bucket_mean, 6) AS bucket_mean FROM ({_tier(0)} UNION ALL {_tier(30)} UNION ALL {_tier(60)})")
def snk06(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("correct", F.col("correct_a"))
    reports = [ledger.report_of(rows.filter(F.col("k") >= t), f"e{t}", "r") for t in (0, 30, 60)]
    tier = ledger.tier_one(reports[0].unionByName(reports[1]).unionByName(reports[2]))
    return rounded(tier.select("experiment", "bucket_mean"), "bucket_mean")


@query("add24_pool", """WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) SELECT label, pos, round(max(v), 4) AS most, round(avg(v::DOUBLE), 4) AS mean FROM x GROUP BY ALL""")
def add24(spark, sf_dir):
    done = features.pool(read(spark, sf_dir, "embeddings"), "label", "embedding")
    return rounded(done.select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.col("most"), "mean"), "most", "mean", places=4)


@query("agg73_linear_probe")
def agg73(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").withColumn("held", F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0)
    return features.linear_probe(rows, "embedding", "label", "held")


@query("add22_blend", "SELECT a.vec_id, round(list_sum(list_transform(a.embedding, lambda x: x * 0.25::DOUBLE + 0.75::DOUBLE)), 3) AS total FROM embeddings a")
def add22(spark, sf_dir):
    mixed = features.blend(F.col("embedding"), F.transform("embedding", lambda x: F.lit(1.0)), 0.75)
    total = F.aggregate(mixed, F.lit(0.0), lambda acc, x: acc + x)
    return rounded(read(spark, sf_dir, "embeddings").select("vec_id", total.alias("total")), "total", places=3)
