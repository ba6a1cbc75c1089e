"""Chat corpora: nested rows from turn tables, JSON lines out and in, manifests with a digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHAT = "key string, messages array<struct<role:string,content:string>>"


def chat_rows(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """key, messages (in turn order), n_turns: one row per conversation."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    done = turns.groupBy(F.col(key).cast("string").alias("key")).agg(ordered.alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return done.select("key", messages.alias("messages"), F.size("m").alias("n_turns"))


def last_pair(chats: DataFrame) -> DataFrame:
    """key, question, answer: the last two messages; conversations with fewer have none."""
    m = F.col("messages")
    return chats.filter(F.size(m) >= 2).select("key", F.element_at(m, -2)["content"].alias("question"), F.element_at(m, -1)["content"].alias("answer"))


def rewrite_answers(chats: DataFrame, answer) -> DataFrame:
    """The last message's content replaced by ``answer`` (a Column); all others as they were."""
    m = F.col("messages")
    last = F.struct(F.element_at(m, -1)["role"].alias("role"), answer.alias("content"))
    return chats.withColumn("messages", F.concat(F.slice(m, 1, F.size(m) - 1), F.array(last)))


def write_json_lines(chats: DataFrame, path: str) -> None:
    chats.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_json_lines(spark: SparkSession, path: str, schema: str = CHAT) -> DataFrame:
    """With a stated schema: no inference, bad lines give NULL rows rather than another schema."""
    return spark.read.schema(schema).json(path)


def digest_of(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """digest: one row, the same for the same tab-joined lines in any order.

    sha256 of every line; of the sorted line digests of each of 4,096 parts (by their
    first three digits); and of the parts' digests in order.
    """
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    lines = rows.select(F.sha2(line, 256).alias("h"))
    parts = lines.groupBy(F.substring("h", 1, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"])
    return parts.agg(F.sha2(F.array_join(ordered, ""), 256).alias("digest"))


def manifest_digest(rows: DataFrame, columns: Sequence[str]) -> str:
    """The digest of a manifest (a table of clusters); see ``digest_of``."""
    return digest_of(rows, columns).first()[0]


def write_manifest(rows: DataFrame, path: str, columns: Sequence[str]) -> str:
    """CSV of a manifest in ordered parts, its digest beside it as a table; returns the digest."""
    digest = manifest_digest(rows, columns)
    rows.select(*columns).repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").csv(f"{path}/manifest", header=True)
    rows.sparkSession.createDataFrame([(digest,)], "sha256 string").coalesce(1).write.mode("overwrite").text(f"{path}/sha256")
    return digest


def read_manifest(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All columns as strings, so that numeric-looking ids survive; raises if the digest differs."""
    rows = spark.read.schema(", ".join(f"{c} string" for c in columns)).csv(f"{path}/manifest", header=True)
    told = spark.read.text(f"{path}/sha256").first()[0]
    if manifest_digest(rows, columns) != told:
        raise ValueError(f"{path}: the manifest is not the one that was written")
    return rows
