"""An index of notes and result files: front matter, Markdown tables, CSV headers, JSON keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def front_value(text: Column, key: str) -> Column:
    """A value of flat ``key: value`` front matter, NULL without one."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    return F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*)$", 1), F.lit(' "')), F.lit(""))


def decisions(notes: DataFrame, statuses: tuple[str, ...] = ("live", "amended", "withdrawn")) -> DataFrame:
    """question, verdict, status, date, path; raises on a status outside the vocabulary."""
    out = notes.select(*(front_value(F.col("value"), k).alias(k) for k in ("question", "verdict", "status", "date")), "path").filter("question is not null")
    if out.filter(~F.coalesce(F.col("status").isin(list(statuses)), F.lit(False))).limit(1).count():
        raise ValueError("a note has an unknown status")
    return out


def table_rows(notes: DataFrame) -> DataFrame:
    """path, line_no, cells of every Markdown table row, separator lines left out; escaped pipes stay in their cell."""
    lines = notes.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).filter(F.trim("line").rlike(r"^\|.*\|$") & ~F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    inner = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    return lines.select("path", "line_no", cells.alias("cells"))


def longest_per_key(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The row with the longest text of each key, the first in order on ties."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.length(text)), text))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def csv_inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, header, n_rows of every CSV file."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.filter(F.split("value", "\r?\n"), lambda x: x != "").alias("l"))
    return lines.select("path", F.get("l", F.lit(0)).alias("header"), F.greatest(F.size("l") - 1, F.lit(0)).alias("n_rows"))


def json_inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, keys (sorted, joined) of every JSON object file; NULL where it isn't an object."""
    docs = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return docs.select("path", F.array_join(F.array_sort(F.json_object_keys("value")), ",").alias("keys"))


def experiment_of(path: Column) -> Column:
    """struct(experiment, run) of ``.../experiments/<experiment>/runs/<run>/...``."""
    return F.struct(F.regexp_extract(path, r"experiments/([^/]+)/", 1).alias("experiment"), F.regexp_extract(path, r"/runs/([^/]+)", 1).alias("run"))
