from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.sources import index, readers


def test_predictions_keep_the_first(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"qID": "a", "content": "1", "latency": 0.5}, {"qID": "a", "content": "2"}, {"qID": "b", "content": None}]))
    got = {r.qID: r.prediction for r in readers.read_predictions(spark, str(tmp_path / "p.json")).collect()}
    assert got == {"a": "1", "b": None}


def test_annotations(spark, tmp_path):
    (tmp_path / "v1.json").write_text(json.dumps({"annotations": {"0": [], "25": [[3, 1]], "50": [[3, 0], [2, 2]], "75": [[2, 1]]}}))
    r = readers.annotated_frames(spark, str(tmp_path), 3).first()
    assert (r.video, r.n_frames, r["first"], r.n_positive) == ("v1", 4, 25, 2)


def test_tagged_union_and_items(spark, tmp_path):
    for name in ("a", "b"):
        spark.createDataFrame([(1, "007", "At 00:00:01?", "yes", "00:00:01", "00:01:31")], "id long, video string, question string, answer string, timestamp_start string, timestamp_end string").write.parquet(str(tmp_path / name))
    rows = readers.tagged_union(spark, {("a", "test"): str(tmp_path / "a"), ("b", "test"): str(tmp_path / "b")})
    got = sorted(readers.items_of(rows, 2.5).collect())
    assert [r.qID for r in got] == ["a__1", "b__1"]
    assert (got[0].video, got[0].duration, got[0].frame_index, got[0].tolerance, got[0].template) == ("007", 90.0, 2, 2.0, "At <TS>?")
    with pytest.raises(ValueError):
        readers.tagged_union(spark, {})


def test_rehost_and_names(spark):
    rows = spark.createDataFrame([(["/old/a.jpg", "/old/b.jpg"],)], "images array<string>")
    assert readers.rehost(rows, "images", "/old", "/new").first().images == ["/new/a.jpg", "/new/b.jpg"]
    with pytest.raises(ValueError):
        readers.rehost(rows, "images", "/older", "/new")
    names = spark.createDataFrame([("d__v__7",), ("d__v",)], "n string").select(readers.frame_name_parts(F.col("n")).alias("p")).collect()
    assert tuple(names[0].p) == ("d", "v", "7") and names[1].p is None
    counted = spark.createDataFrame([(3, ["x"]), (None, ["x", "y"])], "n int, p array<string>")
    assert [(r.value, r.source_of) for r in readers.counts_with_provenance(counted, "n", "p").collect()] == [(3, "field"), (2, "points")]


def test_index_of_notes(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\nquestion: "Is it so?"\nverdict: yes\nstatus: live\ndate: 2026-01-02\n---\n\n| rung | note |\n| --- | --- |\n| 1 | a \\| b |\n')
    notes = index.read_notes(spark, str(tmp_path))
    r = index.decisions(notes).first()
    assert (r.question, r.verdict, r.status, r.date) == ("Is it so?", "yes", "live", "2026-01-02")
    assert [x.cells for x in index.table_rows(notes).orderBy("line_no").collect()] == [["rung", "note"], ["1", "a | b"]]
    (tmp_path / "b.md").write_text("---\nquestion: x\nstatus: odd\n---\n")
    with pytest.raises(ValueError):
        index.decisions(index.read_notes(spark, str(tmp_path)))
    keyed = spark.createDataFrame([("k", "a"), ("k", "abc"), ("j", "x")], "k string, t string")
    assert {r.k: r.t for r in index.longest_per_key(keyed, "k", "t").collect()} == {"k": "abc", "j": "x"}


def test_inventories(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.csv").write_text("a,b\n1,2\n3,4\n")
    r = index.csv_inventory(spark, str(tmp_path / "c")).first()
    assert (r.header, r.n_rows) == ("a,b", 2)
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.json").write_text('{"b": 1, "a": [2]}')
    assert index.json_inventory(spark, str(tmp_path / "j")).first()["keys"] == "a,b"
    e = spark.range(1).select(index.experiment_of(F.lit("r/experiments/07-x/runs/r2/s.json")).alias("e")).first().e
    assert tuple(e) == ("07-x", "r2")
