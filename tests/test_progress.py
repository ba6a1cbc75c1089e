"""Reports of runs: the stream against the batch, across a restart, and silence."""

from __future__ import annotations

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.streaming import progress

EVENTS = "run string, t double, key long, kind string, step long, total long"


def log_of(seed, n=400):
    rng = random.Random(seed)
    rows, at = [], 1000.0
    for key in range(n):
        at += rng.choice([0.1, 0.5, 1.0, 7.0])
        kind = rng.choices(["progress", "stage", "failed", "note"], (80, 4, 2, 8))[0]
        rows.append((rng.choice("abc"), at, key, kind, key if kind == "progress" else None, 1000 if rng.random() < 0.9 else None))
    return rows


def events(df):
    return progress.as_events(df, F.col("run"), F.col("t"), F.col("key"), F.col("kind"), F.col("step"), F.col("total"))


def plain(rows, interval):
    """Reports by a loop over windows."""
    found = []
    for run in sorted({r[0] for r in rows}):
        status, reported, window, step, total, start = "running", None, [], None, None, None
        for _, at, key, kind, s, t in sorted(r for r in rows if r[0] == run):
            start = at if start is None else start
            if kind == "stage":
                status, window, step, total = "running", [], None, None
            elif kind == "failed":
                status = "failed"
            elif s is not None:
                step, total, window = s, t or total, [*window, (at, s)][-64:]
            if kind in ("stage", "failed") or reported is None or at - reported >= interval:
                reported = at
                eta = None
                if step and total and len(window) >= 4 and window[-1][1] > window[0][1] and window[-1][0] > window[0][0]:
                    eta = round((total - step) * (window[-1][0] - window[0][0]) / (window[-1][1] - window[0][1]), 1)
                found.append((run, at, key, status, step, total, round(100 * step / total, 2) if step and total else None, eta, round(at - start, 1)))
    return found


def told(df):
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in df.toPandas().astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("interval", [0.0, 5.0, 1e9])
def test_reports_of_a_log_against_a_loop(spark, interval):
    rows = log_of(1)
    assert told(progress.reports(events(spark.createDataFrame(rows, EVENTS).repartition(3)), interval)) == sorted(plain(rows, interval), key=str)
    assert progress.reports(events(spark.createDataFrame([], EVENTS)), interval).count() == 0


def test_a_restarted_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = log_of(2, 240)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", progress.STATE_STORE)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()

    def arrive(name, part):
        text = "\n".join(json.dumps(dict(zip(("run", "t", "key", "kind", "step", "total"), r, strict=True))) for r in part)
        (tmp_path / "in" / name).write_text(text)

    def run_until_done():
        stream = progress.report_stream(events(spark.readStream.schema(EVENTS).json(source)), 5.0, silence=100.0)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    try:
        for k in range(3):  # each time another query, from the checkpoint of the one before
            arrive(f"{k}.json", rows[80 * k : 80 * (k + 1)])
            run_until_done()
        found = [r for r in told(spark.read.parquet(out)) if r[3] != "stale"]
        assert found == sorted(plain(rows, 5.0), key=str)
        # A later event of another run moves the watermark past the silence of the others.
        arrive("9.json", [("late", rows[-1][1] + 10_000.0, 999, "progress", 1, 10)])
        run_until_done()
        arrive("99.json", [("late", rows[-1][1] + 10_001.0, 1000, "progress", 2, 10)])
        run_until_done()
        last = {r[0]: r for r in sorted(rows)}
        ended = {}
        for r in sorted(rows, key=lambda r: r[1]):
            if r[3] in ("stage", "failed"):
                ended[r[0]] = r[3] == "failed"
        stale = {r[0]: r[1] for r in told(spark.read.parquet(out)) if r[3] == "stale"}
        assert stale == {run: r[1] + 100.0 for run, r in last.items() if not ended.get(run)}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
