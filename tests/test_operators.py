from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import answers, draws, questions
from gaugeworks.operators import comparing, features, gates, joining, labelling, ranking, sampling, scoring, sequences
from gaugeworks.plans import ledger
from gaugeworks.sources import chat
from gaugeworks.streaming import run_log

CLASSES = ["Clip", "Bag"]


def value(spark, column, **cells):
    row = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "number"), [("7", 7), ("about 12 of 3", 12), ("three", 3), ("No clips", 0), ("nothing", None), ("", None), (None, None)]
)
def test_parse_number(spark, text, number):
    assert value(spark, answers.parse_number(F.col("t")), t=text) == number


@pytest.mark.parametrize(("text", "found"), [("clip, BAG", ["Bag", "Clip"]), ("none", ["None"]), ("none, clip", None), ("fork", None), ("", None), ("Clip,clip", ["Clip"])])
def test_class_set(spark, text, found):
    assert value(spark, answers.read_class_set(F.col("t"), CLASSES), t=text) == found


@pytest.mark.parametrize(
    ("a", "b", "answer", "changed"), [("Clip, Bag", "Clip", "clip", True), ("Clip", "Bag", "Clip", False), ("Clip", "none", "none", True), ("Clip", "fork", "Clip", False)]
)
def test_arbitrate(spark, a, b, answer, changed):
    pair = answers.arbitrate(F.col("a"), F.col("b"), CLASSES)
    assert [value(spark, c, a=a, b=b) for c in pair] == [answer, changed]


def test_clock(spark):
    assert value(spark, questions.clock_seconds(F.col("t")), t="27:00:01") == 97201.0
    assert value(spark, questions.seconds_clock(F.col("t").cast("double")), t="97200.5") == "27:00:00"
    assert value(spark, questions.seconds_clock(F.col("t").cast("double")), t="-4") == "00:00:00"
    assert value(spark, questions.shift_clock(F.col("t"), F.lit(60.0)), t="00:00:05, 00:01:00") == "00:01:05, 00:02:00"
    assert value(spark, questions.shift_clock(F.col("t"), F.lit(60.0)), t="00:00:05, soon") == "00:00:05, soon"


def test_leading_premise_is_stripped(spark):
    column = questions.strip_leading(F.col("t"), "there (is|are)")
    assert value(spark, column, t="There, there are two clips. Which?") == "Which?"
    assert value(spark, column, t="Now there are two.") == "Now there are two."


def test_bucket_mean_golden(spark):
    cells = [("a", "ID", 60), ("b", "ID", 61), ("c", "OOD", 42), ("d", "OOD", 57)]
    rows = [(g, "f", d, "t", "x", float(i < n)) for g, d, n in cells for i in range(100)] + [("e", "f", "ID", "t", "x", 1.0)]
    df = spark.createDataFrame(rows, "grp string, fmt string, dist string, template string, answer string, correct double")
    out = scoring.bucket_mean(scoring.stratified_report(df)).first()
    assert out.bucket_mean == pytest.approx(0.55) and out.n_buckets == 4


def test_floor_counts_rows_without_answer(spark):
    df = spark.createDataFrame([("t", "1"), ("t", "1"), ("t", None), (None, "1")], "template string, answer string")
    assert scoring.template_floor(df.withColumn("g", F.lit(1)), ["g"]).first().floor == 0.5


def test_empty_report(spark):
    df = spark.createDataFrame([], "grp string, fmt string, dist string, template string, answer string, correct double")
    assert scoring.stratified_report(df).count() == 0


@pytest.mark.parametrize(
    ("low", "high", "verdict"),
    [(-0.1, 0.1, "EQUIVALENT"), (0.05, 0.1, "TRIVIAL_DIFFERENCE"), (0.3, 0.4, "DIFFERENT"), (-0.3, 0.1, "INCONCLUSIVE"), (-0.2, 0.1, "INCONCLUSIVE"), (None, 0.1, "UNDEFINED")],
)
def test_equivalence(spark, low, high, verdict):
    df = spark.createDataFrame([(low, high)], "l double, h double")
    assert df.select(comparing.equivalence(F.col("l"), F.col("h"), 0.2)).first()[0] == verdict


def test_equivalence_needs_a_margin():
    with pytest.raises(ValueError):
        comparing.equivalence(None, None, 0)


def test_flips(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (0.0, 1.0), (1.0, 1.0)], "correct_a double, correct_b double")
    r = comparing.flips(df).first()
    assert (r.fixed, r.broke, r.delta, r.flip_ratio) == (2, 1, 0.25, 0.5)
    assert comparing.flips(df.filter("correct_a = 1")).first().flip_ratio is None


def test_pairing_raises(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 0.0)], "qid string, correct double")
    assert comparing.pair_arms(a, a).count() == 2
    with pytest.raises(ValueError):
        comparing.pair_arms(a, a.filter("qid = 'x'"))
    with pytest.raises(ValueError):
        comparing.pair_arms(a.union(a), a)


def test_bootstrap_of_equal_clusters_is_exact(spark):
    df = spark.createDataFrame([("c", f"v{i}", 0.25) for i in range(8)], "cell string, video string, x double")
    r = comparing.cluster_bootstrap(df, ["cell"], "video", F.col("x"), draws=20).first()
    assert (r.point, r.ci_low, r.ci_high) == (0.25, 0.25, 0.25)


def test_bootstrap_spread_is_that_of_the_mean(spark):
    x = np.random.default_rng(3).normal(size=60)
    df = spark.createDataFrame([("c", f"v{i:02d}", float(v)) for i, v in enumerate(x)], "cell string, video string, x double")
    r = comparing.cluster_bootstrap(df, ["cell"], "video", F.col("x"), draws=400).first()
    half = 1.96 * x.std() / np.sqrt(len(x))
    assert r.point == pytest.approx(x.mean())
    assert (r.ci_high - r.ci_low) / 2 == pytest.approx(half, rel=0.2)


def test_draws_at_once_are_those_of_the_column(spark):
    df = spark.range(9_990, 10_020).select("id", *(draws.uniform(3, "c", F.lit(cell), F.col("id")).alias(f"u{i}") for i, cell in enumerate(("ID", "é|x", "long " * 12))))
    rows = df.orderBy("id").collect()
    for i, cell in enumerate(("ID", "é|x", "long " * 12)):
        assert draws.uniforms(f"3|c|{cell}", 9_990, 10_020).tolist() == [r[f"u{i}"] for r in rows]
    assert draws.uniforms("3|c", 5, 5).tolist() == []


def test_bootstrap_joins_no_draws(spark):
    """Replicates come out of the tasks, not out of rows for each draw; cells too large for a task give the same by a join."""
    x = np.random.default_rng(5).normal(size=300)
    rows = [("a" if i % 3 else "b", f"v{i:03d}", float(v)) for i, v in enumerate(x)] + [(None, "v", 1.0), ("a", "none", None)]
    df = spark.createDataFrame(rows, "cell string, video string, x double").repartition(5)
    done = [comparing.cluster_bootstrap(df, ["cell"], "video", F.col("x"), draws=40, seed=2, most=most).orderBy("cell") for most in (1000, 150, 1)]
    assert ["sequence(0, 39," in one._jdf.queryExecution().analyzed().toString() for one in done] == [False, True, True]
    want = {}
    for cell in "ab":
        held = [v for c, _, v in rows if c == cell and v is not None]
        u = lambda r, i, n: int(int(hashlib.md5(f"2|c|{cell}|{r}|{i}".encode()).hexdigest()[:8], 16) / 2**32 * n)  # noqa: B023, E731
        want[cell] = np.percentile([np.mean([held[u(r, i, len(held))] for i in range(len(held))]) for r in range(40)], [2.5, 97.5])
    for one in done:
        got = one.collect()
        assert [(r.cell, r.n_clusters) for r in got] == [("a", 200), ("b", 100)]
        for r in got:
            assert (r.ci_low, r.ci_high) == pytest.approx(tuple(want[r.cell]))
    assert comparing.cluster_bootstrap(df.limit(0), ["cell"], "video", F.col("x"), draws=5).collect() == []


def test_every_fold_has_every_group_with_its_split(spark):
    df = spark.createDataFrame([(g,) for g in "aabccc"] + [(None,)], "g string")
    n = {"a": 2, "b": 1, "c": 3, None: 1}
    want = {(fold, g, "val" if fold == g and g else "train", n[g]) for fold in n for g in n}
    got = [tuple(r) for r in sampling.leave_one_out_folds(df, "g").select("fold", "g", "split", "n").collect()]
    assert len(got) == 16 and set(got) == want
    assert sampling.leave_one_out_folds(df.limit(0), "g").collect() == []


def test_spearman_and_auc_against_ranks(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, 80), rng.integers(0, 6, 80)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y, strict=True)], "x int, y int").withColumn("g", F.lit(1))

    def ranks(v):
        return np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])

    assert ranking.spearman(df, ["g"], "x", "y").first().spearman == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    pos = y > 2
    want = np.mean([(a > b) + (a == b) / 2 for a in x[pos] for b in x[~pos]])
    assert ranking.auc(df, ["g"], "x", F.col("y") > 2).first().auc == pytest.approx(want)
    assert ranking.spearman(df.limit(2), ["g"], "x", "y").first().spearman is None


def test_sign_test(spark):
    from math import comb

    for k, n in ((3, 10), (7, 10), (0, 4), (5, 10), (0, 0)):
        got = spark.createDataFrame([(k, n)], "k int, n int").select(comparing.sign_test(F.col("k"), F.col("n"))).first()[0]
        want = min(1.0, 2 * sum(comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)
        assert got == pytest.approx(want)


def test_macro_f1_and_illegal(spark):
    df = spark.createDataFrame([(["a"], ["a"]), (["a", "b"], ["a"]), (["b"], None)], "gold array<string>, pred array<string>")
    r = labelling.macro_f1(df).first()
    assert (r.n, r.n_illegal) == (3, 1) and r.macro_f1 == pytest.approx(0.5) and r.exact_set_acc == pytest.approx(1 / 3)


@pytest.mark.parametrize("n", [1, 7, 100])
def test_stratified_keeps_every_stratum(spark, n):
    df = spark.range(n).withColumn("s", F.col("id") % 3)
    out = sampling.stratified(df, ["s"], "id", 0.1)
    assert out.select("s").distinct().count() == df.select("s").distinct().count()
    assert {r.id for r in out.collect()} == {r.id for r in sampling.stratified(df.repartition(7), ["s"], "id", 0.1).collect()}


def test_quotas_add_up(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "k string, n long")
    assert sum(r.quota for r in sampling.largest_remainder(df, "k", "n", 4).collect()) == 4


def test_donors_come_from_other_clusters(spark):
    df = spark.createDataFrame([(f"q{i}", f"v{i % 4}") for i in range(20)], "qid string, video string")
    of = {r.qid: r.video for r in df.collect()}
    assert all(of[r.qid] != of[r.donor] for r in sampling.shuffle_donors(df, "video", "qid").collect())
    with pytest.raises(ValueError):
        sampling.shuffle_donors(df.withColumn("video", F.lit("v")), "video", "qid")


def test_nearest_ties_take_the_lower_key(spark):
    df = spark.createDataFrame([("v", 10, 1), ("v", 20, 2), ("v", 30, 3)], "video string, t long, id long")
    got = {(r.id, r.neighbour, r.place) for r in sequences.nearest_in_time(df, "video", "t", "id", 1).collect()}
    assert got == {(1, 2, 1), (2, 1, 1), (3, 2, 1)}


def test_nearest_among_many_rows_of_one_moment(spark):
    rows = [("v", t, i) for i, t in enumerate([7, 7, 7, 8, 7, 9, 9, 9, 9, None, 30, None, 8, 7, 9, 40])] + [("w", None, 1), ("w", None, 2), ("x", 1, 1), (None, 1, 1), (None, 1, 2)]
    got = {tuple(r) for r in sequences.nearest_in_time(spark.createDataFrame(rows, "video string, t long, id long"), "video", "t", "id", 2).collect()}
    want = set()
    for v, t, i in rows:
        others = [(None if t is None or u is None else abs(t - u), j) for w, u, j in rows if v is not None and w == v and j != i]
        order = sorted(others, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        want |= {(v, i, j, gap, place) for place, (gap, j) in enumerate(order[:2], 1)}
    assert got == want


def test_upsert_twice_changes_nothing(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    once = joining.upsert_missing(old, new, ["k"])
    assert sorted(map(tuple, joining.upsert_missing(once, new, ["k"]).collect())) == [(1, "a"), (2, "c")]


def test_gates_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    one = df.filter("k = 2")
    for fails in (
        lambda: gates.unique(df, ["k"]),
        lambda: gates.functional(df, "k", "v"),
        lambda: gates.require(df, "v", F.col("v") == "a"),
        lambda: gates.contained(df, one, ["k"]),
        lambda: gates.disjoint(df, one, ["k"]),
        lambda: gates.same_keys(one, df, ["k"]),
        lambda: gates.share_at_most(df, "ones", F.col("k") == 1, 0.5),
        lambda: gates.counts_are(df, ["k"], {(1,): 1, (2,): 1}),
        lambda: gates.known_values(df, "v", ["a"]),
        lambda: gates.round_trips(df.limit(0), F.col("v"), "v"),
        lambda: gates.class_mix(df, "v"),
        lambda: gates.rates_are(df.withColumn("f", F.lit(True)), {"f": 0.5}),
        lambda: gates.no_cluster_lost(one, df, "k"),
        lambda: gates.identical(one, df.filter("v = 'a'"), "k", "v"),
        lambda: gates.close_to(0.5, 0.6, 0.02, "mean"),
    ):
        with pytest.raises(ValueError):
            fails()
    assert gates.unique(one, ["k"]).count() == 1
    assert gates.counts_are(df, ["k"], {(1,): 2, (2,): 1}).count() == 3


def test_manifest_keeps_ids_and_detects_edits(spark, tmp_path):
    df = spark.createDataFrame([("007", "train"), ("1e5", "val")], "video string, split string")
    chat.write_manifest(df, str(tmp_path / "m"), ["video", "split"])
    back = chat.read_manifest(spark, str(tmp_path / "m"), ["video", "split"])
    assert sorted(r.video for r in back.collect()) == ["007", "1e5"]
    df.limit(1).coalesce(1).write.mode("overwrite").csv(str(tmp_path / "m" / "manifest"), header=True)
    with pytest.raises(ValueError):
        chat.read_manifest(spark, str(tmp_path / "m"), ["video", "split"])


def test_chat_round_trip(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "how many?"), (1, 1, "assistant", "two"), (2, 0, "user", None)], "c long, t long, r string, x string")
    rows = chat.chat_rows(turns, "c", "t", "r", "x")
    chat.write_json_lines(rows.select("key", "messages"), str(tmp_path / "j"))
    back = chat.read_json_lines(spark, str(tmp_path / "j"))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.select("key", "messages").collect()))
    assert [tuple(r) for r in chat.last_pair(back).collect()] == [("1", "how many?", "two")]


def test_ledger_tiers(spark, tmp_path):
    rows = spark.createDataFrame([("a", "f", "ID", "t", "x", float(i % 2)) for i in range(10)], "grp string, fmt string, dist string, template string, answer string, correct double")
    reports = ledger.report_of(rows, "e1", "r1").unionByName(ledger.report_of(rows.limit(1), "e2", "r1"))
    tier = ledger.tier_one(reports)
    assert [r.experiment for r in tier.collect()] == ["e1", "e2"] and tier.collect()[1].bucket_mean is None
    ledger.write(reports, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "by_run")).count() == reports.count()
    assert "| e1 | r1 | 0.5000 |" in ledger.markdown(tier, ["experiment", "run", "bucket_mean"])


def test_run_log_stream(spark, tmp_path):
    lines = spark.createDataFrame([("10%| 1/10 loss: 0.5\r20%| 2/10 loss=0.25 epoch: 1.5\n",)], "value string")
    got = [tuple(r.p) for r in run_log.fragments(lines).select(run_log.progress(F.col("fragment")).alias("p")).collect()]
    assert got == [(1, 10, 0.5, None), (2, 10, 0.25, 1.5)]
    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(json.dumps({"ts": t, "run": r, "kind": k, "stage": "s"}) for t, r, k in ((1.0, "x", "start"), (5.0, "x", "finish"), (2.0, "y", "start"))))
    state = run_log.latest_state(run_log.read_events(spark, str(folder), streaming=True))
    q = state.writeStream.outputMode("complete").format("memory").queryName("run_state").start()
    q.processAllAvailable()
    q.stop()
    found = {r.run: (r.kind, r.n_events) for r in spark.table("run_state").collect()}
    assert found == {"x": ("finish", 2), "y": ("start", 1)}
    assert [r.run for r in run_log.stale(spark.table("run_state"), 1000.0).collect()] == ["y"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1.", "1"), ("1 .", "1"), (" 12 ", "12"), ("Yes.", "yes"), ("NO .", "no"), ("Yes", "Yes"), ("NO", "NO"), ("1:02:03.", "1:02:03"), ("10:02:03, 1:02:03 .", "10:02:03, 1:02:03"),
        ("1.5", "1.5"), ("a.", "a."), (None, ""), ("1..", "1.."), ("yes. no.", "yes. no."), ("1:02:03", "1:02:03"),
    ],
)
def test_normalise_answer(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(answers.normalise_answer(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("a", "b", "want", "changed"),
    [
        ("clip, bag", "clip", "clip", True), ("clip, bag", "none", "none", True), ("clip, bag", "no", "clip, bag", False), ("clip", "No foreign objects.", "none", True), ("clip, bag", "Bag and clip", "clip, bag", False),
        ("clip, bag", "bag; what", "clip, bag", False), ("3", "none", "3", False), ("none", "clip", "none", False), ("clip, Bag", "BAG.", "Bag", True), (None, "clip", None, False), ("clip", "", "clip", False),
    ],
)
def test_arbitrate(spark, a, b, want, changed):
    answer, took = answers.arbitrate(F.col("a"), F.col("b"), ["Bag", "clip"])
    assert tuple(spark.createDataFrame([(a, b)], "a string, b string").select(answer, took).first()) == (want, changed)


@pytest.mark.parametrize(
    ("text", "want", "status"),
    [
        ("3", "3", "bare_int"), ("3.", "3", "salvaged"), ("007", "7", "bare_int"), ("000", "0", "bare_int"), ("counts: 4, 5", "4", "structured"), ("count: 4, 5", "0", "malformed"), ("{'counts': '04'", "4", "structured"),
        ('"Counts" : 12 of 13', "12", "structured"), ("two of 9", "9", "salvaged"), ("1 or 2", "0", "malformed"), ("", "0", "malformed"), (None, "0", "malformed"),
    ],
)
def test_parse_count(spark, text, want, status):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(answers.parse_count(F.col("t")).alias("p")).select("p.*").first()) == (want, status)


@pytest.mark.parametrize(
    ("text", "want"),
    [("top/left", "top/right"), ("Bottom/Right, TOP/LEFT", "Bottom/Left, TOP/RIGHT"), ("top-left left", "top-left left"), ("atop/left top/leftmost", "atop/left top/leftmost"), ("top/LEFT", "top/RIGHT")],
)
def test_swap_sides(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(questions.swap_sides(F.col("t"))).first()[0] == want


def test_running_totals(spark):
    from gaugeworks.operators.ranges import running_totals

    rows = [(i * 37 % 101, i % 7) for i in range(101)]
    out = running_totals(spark.createDataFrame(rows, "k long, v long").withColumn("one", F.lit(1)), ["-v", "k"], {"rank": "one", "upto": "v"}).collect()
    total, want = 0, set()
    for n, (k, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += v
        want.add((k, n, total))
    assert {(r.k, r["rank"], r.upto) for r in out} == want
    assert running_totals(spark.createDataFrame([], "k long, v long"), ["k"], {"upto": "v"}).collect() == []


def test_sign_test_of_many(spark):
    from math import comb

    cases = [(0, 1), (3, 10), (5, 10), (480, 1000), (900, 2000), (2400, 5000), (0, 3000)]
    got = spark.createDataFrame(cases, "k int, n int").select(comparing.sign_test(F.col("k"), F.col("n"))).collect()
    want = [min(1.0, float(2 * sum(comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)) for k, n in cases]
    assert [r[0] for r in got] == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_linear_probe_learns(spark):
    from gaugeworks.operators import features

    rng = np.random.default_rng(1)
    rows = [([float(x) for x in rng.normal(3.0 * (i % 3 == 0), 1, 20)] + [float(4.0 * (i % 3 == 1))], i % 3, i % 5 == 0) for i in range(300)]
    out = features.linear_probe(spark.createDataFrame(rows, "v array<double>, y int, held boolean"), "v", "y", "held").collect()
    assert out and max(x for r in out for x in r if isinstance(x, float)) > 0.9


def test_points_and_lists(spark):
    row = spark.createDataFrame([('See [[1, 2], {"x": 3, "y": 4}]', "1. a\n2) b\n7. c", '[{"point_2d": [1, 2]}, {"point_2d": [3,', " 12 ")], "a string, b string, c string, d string")
    got = row.select(answers.points_in(F.col("a")).alias("p"), answers.last_number(F.col("b")), answers.count_points(F.col("c")), answers.bare_count(F.col("d")), answers.points_in(F.col("b"))).first()
    assert got.p.status == "ok" and [(x.x, x.y) for x in got.p.points] == [(1, 2), (3, 4)] and tuple(got)[1:4] == (7, 1, 12) and got[4].status == "unparseable"


@pytest.mark.parametrize(("clusters", "buckets"), [(1, 1), (40, 3), (700, 3), (900, 4096)])
def test_counts_of_the_tree_are_those_of_draws(clusters, buckets):
    """Each replicate draws every cluster once on the mean, as many as there are in all, with the spread and the covariance of a multinomial."""
    from gaugeworks.operators import resampling

    edges = sorted(np.random.default_rng(clusters).integers(0, clusters + 1, buckets - 1).tolist()) if buckets < 10 else list(range(1, 4)) * 1
    starts = [0, *edges, clusters]
    draws, total, seen = 400, np.zeros(400), []
    for bucket in range(len(starts) - 1):
        n = starts[bucket + 1] - starts[bucket]
        # A cluster of mean 1 each: the sum is the number of draws that fell into the bucket.
        sums = resampling.bucket_sums(3, 99, starts, bucket, [[1.0]] * n, [[2]] * n, draws, False) if n else resampling.counts_of(3, 99, starts, bucket, draws).astype(float)
        assert (sums == resampling.counts_of(3, 99, starts, bucket, draws)).all() and (n or not sums.any())
        total += sums
        seen.append((n, sums))
    assert (total == clusters).all()
    for n, sums in seen:
        p = n / clusters
        assert abs(sums.mean() - n) <= 5 * np.sqrt(clusters * p * (1 - p) / draws) + 1e-9
        if 0 < p < 1 and clusters * p * (1 - p) > 5:
            assert 0.75 < sums.var() / (clusters * p * (1 - p)) < 1.3


def test_tree_bootstrap_is_that_of_plain_draws(spark, monkeypatch):
    """One level, hot cells, null cells, clusters of NULLs; leaves small enough that the tree has several levels."""
    from gaugeworks.operators import resampling

    monkeypatch.setattr(resampling, "LEAF", 16)
    rng = np.random.default_rng(2)
    means = {c: rng.normal(size=n) for c, n in (("A", 300), ("B", 1), (None, 20))}
    rows = [(c, f"v{i:03d}", float(m + d)) for c, ms in means.items() for i, m in enumerate(ms) for d in (-0.5, 0.5)] + [("A", "empty", None)]
    df = spark.createDataFrame(rows, "cell string, video string, x double")
    found = set()
    for n in (1, 5):
        got = {r.cell: r for r in resampling.tree_bootstrap(df.repartition(n), ["cell"], "video", F.col("x"), draws=800, seed=4).collect()}
        found.add(tuple(sorted((str(c), r.ci_low, r.ci_high) for c, r in got.items())))
    assert len(found) == 1
    for c, ms in means.items():
        assert (got[c].n, got[c].n_clusters) == (2 * len(ms), len(ms)) and got[c].point == pytest.approx(ms.mean())
        plain = np.percentile([rng.choice(ms, len(ms)).mean() for _ in range(4000)], [2.5, 97.5])
        slack = 0.25 * (plain[1] - plain[0]) + 1e-9
        assert abs(got[c].ci_low - plain[0]) < slack and abs(got[c].ci_high - plain[1]) < slack


def test_two_level_bootstrap_is_that_of_resampled_rows(spark):
    """The interval of 2,000 draws lies where one from rows drawn one by one does."""
    rng = np.random.default_rng(5)
    groups = [rng.random(40) < p for p in rng.uniform(0.3, 0.8, size=25)]
    df = spark.createDataFrame([("A", i, float(x)) for i, g in enumerate(groups) for x in g], "cell string, video int, x double")
    r = comparing.hierarchical_bootstrap(df, ["cell"], "video", F.col("x")).first()
    plain = [np.mean([rng.choice(groups[c], 40).mean() for c in rng.integers(0, 25, 25)]) for _ in range(2000)]
    low, high = np.percentile(plain, [2.5, 97.5])
    assert abs(r.ci_low - low) < 0.012 and abs(r.ci_high - high) < 0.012
    assert r.point == pytest.approx(np.mean([g.mean() for g in groups]))


def test_two_level_bootstrap_of_odd_tables(spark):
    empty = spark.createDataFrame([], "cell string, video string, x double")
    assert comparing.hierarchical_bootstrap(empty, ["cell"], "video", F.col("x"), draws=5).count() == 0
    many = spark.range(2000).select(F.lit("A").alias("cell"), F.lit("v").alias("video"), F.col("id").cast("double").alias("x"))
    with pytest.raises(ValueError, match="distinct values"):
        comparing.hierarchical_bootstrap(many, ["cell"], "video", F.col("x"), draws=5)


@pytest.mark.parametrize(
    ("text", "legal"),
    [("None, Clip", "Clip"), ("clip,BAG", "clip, BAG"), ("Clip, Fork", "Clip"), ("Clip, Needle", "Clip, Needle"), ("Clip, 10:02", "Clip, 10:02"), ("Fork", "Fork"), ("none, Fork", "Fork"), (" none ", "none"), ("", ""), (None, "")],
)
def test_canonical_classes(spark, text, legal):
    assert value(spark, answers.canonical_classes(F.col("t"), CLASSES, "A needle is thin."), t=text) == legal


@pytest.mark.parametrize(
    ("text", "fmt", "read"),
    [("1.", "number", ("1", False, True, False)), ("0", "number", ("0", True, True, True)), ("007 clips", "number", ("7", False, True, False)), ("none", "number", (None, False, False, False)),
     ("No.", "binary", ("no", True, True, False)), (" YES", "binary", ("yes", False, True, True)), ("yesterday", "binary", (None, False, False, False)), (None, "binary", (None, False, False, False))],
)
def test_meant_and_valid(spark, text, fmt, read):
    assert tuple(value(spark, answers.meant_and_valid(F.col("t"), F.col("f")), t=text, f=fmt)) == read


def test_boxes_count_and_padded_video(spark):
    of = lambda t: tuple(value(spark, answers.boxes_count(F.col("t")), t=t))
    assert of("No tools detected.") == (0, [], "zero")
    assert of("hook (1, 2), (3, 4) and big hook(5,6),(7,8)") == (2, ["hook", "and big hook"], "clean")
    assert of(f"{answers.REFERENCE_TOKEN}hook (1, 2), (3, 4){answers.REFERENCE_TOKEN}") == (2, [], "corrupted_ref")
    assert of("hook (1, 2)") == of("") == of(None) == (None, [], "unparsed")
    for path, padded in (("a/VID2/1.png", "a/VID02/1.png"), ("a/VID002/1.png", "a/VID02/1.png"), ("a/VID123/1.png", "a/VID123/1.png"), ("a/VID0/VID7", "a/VID00/VID7")):
        assert value(spark, answers.padded_video(F.col("t")), t=path) == padded


def test_difference_in_differences(spark):
    df = spark.createDataFrame([("x", 0.5, 0.52, 0.6, 0.61), ("y", 0.5, 0.7, 0.6, 0.6), ("z", None, 0.5, 0.5, 0.5)], "k string, a0 double, b0 double, a1 double, b1 double")
    got = {r.k: r for r in comparing.difference_in_differences(df, "k", 0.05, ("a0", "b0"), ("a1", "b1")).collect()}
    assert [got[k].control for k in "xyz"] == ["GREEN", "RED", None]
    assert [got[k].verdict for k in "xyz"] == ["SAME_EFFECT", "NOT_SEPARABLE", None]
    assert got["y"].did == pytest.approx(0.2)


def test_run_liveness(spark):
    rows = [("r", i, 0.0 if i == 3 else 1.0, None if i % 2 else float(50 - i)) for i in range(40)] + [("dead", i, None, None) for i in range(2)]
    got = {r.run: r for r in comparing.run_liveness(spark.createDataFrame(rows, "run string, step int, grad double, loss double"), "run", ["step"], "grad", "loss").collect()}
    assert (got["r"].n_logged, got["r"].moved, got["r"]["first"], got["r"]["last"]) == (40, 39 / 40, 41.0, 21.0)
    assert (got["dead"].n_logged, got["dead"].moved, got["dead"]["first"]) == (0, None, None)


def test_argument_diff(spark):
    a = spark.createDataFrame([("lr", "1"), ("model", "x"), ("same", None), ("only_a", None)], "k string, v string")
    b = spark.createDataFrame([("lr", "2"), ("model", "y"), ("same", None), ("only_b", "1")], "k string, v string")
    got = {tuple(r) for r in comparing.argument_diff(a, b, "k", "v", ["model"]).collect()}
    assert got == {("lr", "1", "2", False), ("model", "x", "y", True), ("only_a", None, None, False), ("only_b", None, "1", False)}


def test_resumed_run(spark):
    rows = spark.range(10).withColumnRenamed("id", "key")
    seen = []

    def make(todo):
        seen.extend(r.key for r in todo.collect())
        return todo.select("key", (F.col("key") * 2).alias("v"))

    done = spark.createDataFrame([(1, 100), (1, 100), (4, 400)], "key long, v long")
    assert {tuple(r) for r in joining.resumed(rows, done, "key", make).collect()} == {(k, k * 100 if k in (1, 4) else 2 * k) for k in range(10)}
    assert sorted(seen) == [0, 2, 3, 5, 6, 7, 8, 9]


def test_one_vs_rest_probe(spark):
    rng = np.random.default_rng(2)
    rows = [([float(x) for x in rng.normal(0, 0.3, 4) + 3 * np.eye(4)[c]], c, i % 4 == 0) for i, c in enumerate(np.repeat([0, 1, 2], [60, 25, 10]).tolist())]
    df = spark.createDataFrame(rows, "x array<double>, y int, held boolean")
    for r in features.one_vs_rest_probe(df, "x", "y", "held").collect():
        assert r.exact > 0.95 and r.n == sum(h == r.held for _, _, h in rows)
    alike = features.one_vs_rest_probe(df.withColumn("y", F.lit(7)), "x", "y", "held").collect()
    assert all(r.exact == 1 and r.n_named == 1 for r in alike)
    assert features.one_vs_rest_probe(df.limit(0), "x", "y", "held").count() == 0


def test_point_scores_and_verdict(spark):
    rows = [(1, "ok", [(1.0, 1.0), (9.0, 9.0)], [(0.0, 0.0, 2.0, 2.0)]), (2, "ok", [(1.0, 2.0), (2.0, 1.0)], [(0.0, 0.0, 2.0, 2.0), (5.0, 5.0, 6.0, 6.0)]), (0, "ok", [], []), (2, "unparseable", [], [(0.0, 0.0, 1.0, 1.0)])]
    df = spark.createDataFrame(rows, "g int, status string, p array<struct<x:double,y:double>>, r array<struct<x0:double,y0:double,x1:double,y1:double>>")
    df = df.select("g", "status", scoring.point_scores(F.col("p"), F.col("r")).alias("score"), F.lit("ok").alias("count_status"), F.lit(True).alias("count_correct"), F.lit(False).alias("legal"))
    report = scoring.point_report(df, "g")
    got = {r.g: r for r in report.collect()}
    assert (got[1].mean_precision, got[1].mean_coverage) == (0.5, 1.0)
    assert (got[2].mean_precision, got[2].mean_coverage, got[2].n_point_parse_fail, got[2].illegal_rate) == (1.0, 0.5, 1, 1.0)
    assert (got[0].mean_n_points, got[0].mean_precision, got[0].mean_coverage) == (0.0, None, None)
    assert tuple(scoring.point_verdict(report, "g").first()) == ("collapse", 0.0)
    assert tuple(scoring.point_verdict(report.filter("g < 2"), "g").first()) == ("inconclusive", None)


def test_place_within_a_hot_key(spark):
    from gaugeworks.operators import ranges

    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 5}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(5)
    got = {(r.k, r.i): r.place for r in ranges.place_within(df, ["k"], ["i"], "place").collect()}
    assert got == {(k, i): sum(1 for a, b in rows if a == k and b <= i) for k, i in rows}
