"""Item, label and sequence tables projected from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.draws import uniform


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per event: ids, group, distribution, format, gold answer, template and two arms' correctness."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    shifted = F.col("event_type").isin("error", "purchase")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.concat_ws("__", "event_type", "event_id").alias("qid"),
        F.col("user_id").cast("string").alias("video"),
        F.col("event_type").alias("grp"),
        F.when(shifted, "OOD").otherwise("ID").alias("dist"),
        F.element_at(F.array(F.lit("number"), F.lit("binary"), F.lit("fo_class")), k % 3 + 1).alias("fmt"),
        (k % 5).alias("answer"),
        F.concat(F.lit("T"), k % 7).alias("template"),
        (uniform(0, "a", F.col("event_id")) < 0.55).cast("double").alias("correct_a"),
        (uniform(0, "b", F.col("event_id")) < 0.60).cast("double").alias("correct_b"),
        F.floor(uniform(0, "p", F.col("event_id")) * 5).cast("int").alias("pred"),
        F.unix_timestamp("ts").alias("t"),
        "value",
        k.alias("k"),
    )


ITEMS = """ev AS (
    SELECT event_id, event_type || '__' || event_id AS qid, user_id::VARCHAR AS video, event_type AS grp,
           CASE WHEN event_type IN ('error', 'purchase') THEN 'OOD' ELSE 'ID' END AS dist,
           ['number', 'binary', 'fo_class'][k % 3 + 1] AS fmt, k % 5 AS answer, 'T' || (k % 7) AS template,
           (('0x' || substr(md5('0|a|' || event_id), 1, 8))::UBIGINT / 4294967296.0 < 0.55)::INT::DOUBLE AS correct_a,
           (('0x' || substr(md5('0|b|' || event_id), 1, 8))::UBIGINT / 4294967296.0 < 0.60)::INT::DOUBLE AS correct_b,
           floor(('0x' || substr(md5('0|p|' || event_id), 1, 8))::UBIGINT / 4294967296.0 * 5)::INT AS pred,
           floor(epoch(ts))::BIGINT AS t, value, k
    FROM (SELECT *, regexp_extract(props, '(\\d+)', 1)::INT AS k FROM events))"""


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: score is the length, label the quality, cluster the source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("score"))
    return docs.join(read(spark, sf_dir, "labels"), "doc_id")


SCORED = """dl AS (
    SELECT d.doc_id, lang, source, n_chars::DOUBLE AS score, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def order_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted label sets of every order, as sorted arrays of return flags."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    return lines.groupBy(F.col("l_orderkey").alias("key")).agg(
        F.array_sort(F.collect_set("l_returnflag")).alias("gold"),
        F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 10, F.col("l_returnflag")))).alias("pred"),
    )


SETS = """os AS (
    SELECT l_orderkey AS key, list_sort(list(DISTINCT l_returnflag)) AS gold,
           coalesce(list_sort(list(DISTINCT l_returnflag) FILTER (WHERE l_quantity > 10)), []) AS pred
    FROM lineitem GROUP BY l_orderkey)"""
