"""Readers of item, prediction and annotation files: stated schemas, tags from paths, nothing inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import questions

PREDICTIONS = "qID string, content string, latency double"
ANNOTATIONS = "annotations map<string, array<array<int>>>"


def tagged_union(spark: SparkSession, paths: dict[tuple[str, str], str], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet of several (dataset, split) paths, each tagged; only ``columns`` are read."""
    out = None
    for (dataset, split), path in paths.items():
        part = spark.read.parquet(path)
        part = (part.select(*columns) if columns else part).withColumns({"dataset": F.lit(dataset), "split": F.lit(split)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


def path_tag(pattern: str, group: int = 1) -> Column:
    """A tag taken from the path of the file that a row came from."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


def items_of(rows: DataFrame, fps: float) -> DataFrame:
    """Request and reference sides of source rows: namespaced id, seconds, frame number, tolerance."""
    start, end = questions.clock_seconds(F.col("timestamp_start")), questions.clock_seconds(F.col("timestamp_end"))
    return rows.select(
        questions.item_id(F.col("dataset"), F.col("id")).alias("qID"),
        "dataset",
        F.col("video").cast("string").alias("video"),
        "question",
        "answer",
        start.alias("start"),
        (end - start).alias("duration"),
        F.bround(start * F.lit(fps), 0).cast("long").alias("frame_index"),
        questions.threshold_seconds(end - start).alias("tolerance"),
        questions.template_of(F.col("question")).alias("template"),
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of answers, one row per id: the first in file order; repeated ids are not an error here."""
    rows = spark.read.schema(PREDICTIONS).json(path, multiLine=True).withColumn("_place", F.monotonically_increasing_id())
    return rows.groupBy("qID").agg(F.min_by(F.struct("content", "latency"), "_place").alias("p")).select("qID", F.col("p.content").alias("prediction"), "p.latency")


def annotated_frames(spark: SparkSession, path: str, code: int) -> DataFrame:
    """video, n_frames, first, n_positive of nested annotation files: frames that carry ``code`` in any tuple."""
    return positives_of(spark.read.schema(ANNOTATIONS).json(path, multiLine=True).select(path_tag(r"([^/]+)\.json$").alias("video"), "annotations"), code)


def positives_of(rows: DataFrame, code: int) -> DataFrame:
    """The same of rows of video and annotations (frame to tuples)."""
    rows = rows.select("video", F.explode("annotations").alias("frame", "tuples"))
    has = F.exists("tuples", lambda t: F.get(t, F.lit(0)) == code)
    frame = F.col("frame").cast("int")
    return rows.groupBy("video").agg(
        F.count(F.lit(1)).alias("n_frames"), F.min(F.when(has, frame)).alias("first"), F.count_if(has).alias("n_positive")
    )


def counts_with_provenance(rows: DataFrame, count: str, points: str) -> DataFrame:
    """A stated count, else the number of points, and where it came from."""
    return rows.select("*", F.coalesce(F.col(count), F.size(points)).alias("value"), F.when(F.col(count).isNotNull(), "field").when(F.col(points).isNotNull(), "points").alias("source_of"))


def rehost(chats: DataFrame, images: str, old: str, new: str) -> DataFrame:
    """Path roots of an image list replaced; raises if a path lies outside the old root."""
    bad = chats.filter(F.exists(images, lambda x: ~F.startswith(x, F.lit(old)))).limit(1).count()
    if bad:
        raise ValueError("a path lies outside the old root")
    return chats.withColumn(images, F.transform(images, lambda x: F.concat(F.lit(new), F.substr(x, F.lit(len(old) + 1)))))


def frame_name_parts(name: Column) -> Column:
    """struct(dataset, video, frame) of ``a__b__c``; NULL unless there are exactly three parts."""
    parts = F.split(name, "__")
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("dataset"), parts[1].alias("video"), parts[2].alias("frame")))


def ordered_fallback(sources: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """key, value from the first source that has the key."""
    ranked = None
    for k, rows in enumerate(sources):
        part = rows.select(key, value, F.lit(k).alias("_rank"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy(key).agg(F.min_by(value, F.struct("_rank", value)).alias(value))
