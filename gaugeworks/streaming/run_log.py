"""Run logs as streams: progress fragments, the latest state of every run, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "ts double, run string, kind string, stage string, note string"


def fragments(lines: DataFrame, text: str = "value") -> DataFrame:
    """Progress bars overwrite themselves: a line holds fragments between carriage returns."""
    others = [c for c in lines.columns if c != text]
    parts = lines.select(*others, F.explode(F.split(F.col(text), "[\r\n]")).alias("fragment"))
    return parts.filter(F.trim("fragment") != "")


def progress(fragment: Column) -> Column:
    """struct(step, total, loss, epoch) of a log fragment, NULL where it doesn't say."""
    def number(pattern: str, kind: str) -> Column:
        return F.nullif(F.regexp_extract(fragment, pattern, 1), F.lit("")).cast(kind)

    return F.struct(
        number(r"\b(\d+)/\d+\b", "long").alias("step"),
        number(r"\b\d+/(\d+)\b", "long").alias("total"),
        number(r"loss['\"]?\s*[:=]\s*([-+0-9.eE]+)", "double").alias("loss"),
        number(r"epoch['\"]?\s*[:=]\s*([0-9.]+)", "double").alias("epoch"),
    )


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Append-only JSON lines of run events, with a stated schema."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(EVENT).json(path)


def latest_state(events: DataFrame) -> DataFrame:
    """run, kind, stage, ts of the last event, and how many there were; also over a stream (complete or update mode)."""
    last = F.max(F.struct("ts", "kind", "stage"))
    done = events.groupBy("run").agg(last.alias("last"), F.count(F.lit(1)).alias("n_events"))
    return done.select("run", "last.ts", "last.kind", "last.stage", "n_events")


def stale(state: DataFrame, now: float, most_age: float = 300.0) -> DataFrame:
    """Runs without an event for longer than ``most_age`` seconds that haven't finished."""
    age = F.lit(now) - F.col("ts")
    return state.filter((F.col("kind") != "finish") & (age > most_age)).withColumn("age", age)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key; rows later than the watermark are left out of a stream's result."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n"
    )
