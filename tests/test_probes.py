"""Hash index, boxes, losses, descriptors, published versions and verdicts against plain versions."""

from __future__ import annotations

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
from oracle import same
from pyspark.sql import Row
from pyspark.sql import functions as F

from gaugeworks import registry
from gaugeworks.functions import answers, descriptors, questions, sketches
from gaugeworks.operators import boxes, comparing, hamming, losses
from gaugeworks.operators.gates import GateError
from gaugeworks.sources import publish

registry.load()


@pytest.mark.parametrize(("bits", "width", "b"), [(0, 64, None), (3, 64, None), (3, 64, 2), (8, 64, None), (8, 64, 3), (5, 20, None), (14, 56, None), (7, 64, 64)])
def test_near_hashes_against_all_pairs(spark, bits, width, b):
    rng = random.Random(bits)
    base = [rng.getrandbits(width) for _ in range(25)]
    near = [h ^ sum(1 << i for i in rng.sample(range(width), rng.randrange(bits + 3))) for h in base for _ in range(3)]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    left, right = [signed(h) for h in base + base[:3]], [signed(h) for h in near + base]
    frame = lambda hs: spark.createDataFrame([(h,) for h in [*hs, None]], "h long").repartition(3)
    got = {(r.h1, r.h2, r.distance) for r in hamming.near_hashes(frame(left), frame(right), bits, width, b).collect()}
    apart = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    assert got == {(x, y, apart(x, y)) for x in left for y in right if apart(x, y) <= bits}


@pytest.mark.parametrize(("bits", "tile"), [(0, 1000), (3, 20), (14, 7), (64, 50)])
def test_near_totals_against_all_pairs(spark, bits, tile):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(25)]
    near = [h ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(18))) for h in base for _ in range(4)]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    left, right = [signed(h) for h in base + base[:3]], [(1000 - i, signed(h)) for i, h in enumerate(near + base + near[:30])]
    ours = spark.createDataFrame([(h,) for h in [*left, None]], "h long").repartition(3)
    theirs = spark.createDataFrame([*right, (1, None)], "vec_id long, h long").repartition(3)
    apart = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    met = {x: [(k, apart(x, y)) for k, y in right if apart(x, y) <= bits] for x in left}
    got = [tuple(r) for r in hamming.near_totals(ours, theirs, bits, "vec_id", tile).collect()]
    assert sorted(got) == sorted((x, len(m), min(m)[0], min(d for _, d in m)) for x, m in met.items() if m)
    assert {(r.h1, r.n_close, r.least) for r in hamming.near_totals(ours, theirs, bits).collect()} == {(x, n, None) for x, n, _, _ in got}
    assert hamming.near_totals(ours, theirs.limit(0), bits).collect() == []


def test_close_grids_make_no_rows_for_pairs(spark, tmp_path):
    """400 grids that are all close to each other: what is shuffled are rows for grids, not for pairs of them."""
    rng = np.random.default_rng(0)
    spark.createDataFrame([(i, [float(x) for x in np.arange(64) + rng.normal(scale=0.4, size=64)], i % 10) for i in range(400)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("jon15_close_grids", "jon15_overlap_gate"):
        done = registry.QUERIES[name](spark, str(tmp_path))
        assert done.collect()
        assert "shiftrightunsigned" not in done._jdf.queryExecution().analyzed().toString()
    same(registry.QUERIES["jon15_close_grids"](spark, str(tmp_path)), connect_to(tmp_path), registry.ORACLES["jon15_close_grids"])


def connect_to(path):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet/*.parquet'")
    return con


def test_blocks_keep_candidates_few():
    for n in (10**3, 10**6, 10**9):
        for bits in (3, 8):
            b = hamming.blocks_for(n, bits)
            assert n / 2.0 ** (64 // b) < 10_000
    with pytest.raises(ValueError):
        hamming.near_hashes(None, None, 65)


def test_texts_with_one_word_changed_are_found(spark, sf_dir):
    """Recall of the registered threshold is 0.9 or more on texts of 60 words and more."""
    from gaugeworks.plans.joining import CLOSE_BITS

    rng = random.Random(1)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text and len(r.text.split()) >= 60]

    def changed(text):
        words = text.split()
        words[rng.randrange(len(words))] = "changedword"
        return " ".join(words)

    df = spark.createDataFrame([(i, t, changed(t)) for i, t in enumerate(texts)], "i int, a string, b string")
    hashes = df.select("i", *(sketches.simhash(sketches.shingle_hashes(F.col(c))).alias(c) for c in "ab")).collect()
    left, right = (spark.createDataFrame([(r[c],) for r in hashes], "h long") for c in "ab")
    found = {(r.h1, r.h2) for r in hamming.near_hashes(left, right, CLOSE_BITS).collect()}
    assert sum((r.a, r.b) in found for r in hashes) >= 0.9 * len(hashes)


def test_difference_hash(spark):
    grids = [list(np.random.default_rng(i).normal(size=12)) for i in range(5)] + [[1.0] * 12, [1.0] * 11, None]
    df = spark.createDataFrame([([float(x) for x in g] if g else None,) for g in grids], "g array<double>")
    got = [r[0] for r in df.select(hamming.difference_hash(F.col("g"), 4, 3)).collect()]
    plain = lambda g: int("".join(str(int(g[r * 4 + c] < g[r * 4 + c + 1])) for r in range(3) for c in range(3)), 2)
    assert got == [plain(g) if g and len(g) == 12 else None for g in grids]
    with pytest.raises(ValueError):
        hamming.difference_hash(F.col("g"), 10, 9)


def test_overlap_aborts_on_held_out_hits_only(spark):
    ours = spark.createDataFrame([(0b1111, False), (0b0000, True), (0b1111, False), (1 << 40, True)], "h long, held boolean")
    told = lambda hs: hamming.overlap(ours, spark.createDataFrame([(h,) for h in hs], "h long"), "held", 1).first().asDict()
    assert told([0b1110, 0b1110]) == {"n_ours": 3, "n_theirs": 1, "hits_train": 2, "hits_val": 0, "nearest": 1, "abort": False}
    assert told([(1 << 40) | 1, 7 << 50])["abort"] is True
    assert told([]) == {"n_ours": 3, "n_theirs": 0, "hits_train": 0, "hits_val": 0, "nearest": None, "abort": False}


def ratio(a, b):
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(wide, 0) * max(high, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union else 0.0


def made_boxes(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(-20, 60), rng.randrange(60)
        rows.append((f"v{rng.randrange(2)}", rng.choice([0, 1, 2, 5]), i, float(x), float(y), float(x + rng.randrange(25)), float(y + rng.randrange(25))))
    return rows


def test_suppression_against_a_loop(spark):
    rows = made_boxes(1, 120)
    df = spark.createDataFrame([(f"{v}-{t}", *r) for v, t, *r in rows], "frame string, key int, x0 double, y0 double, x1 double, y1 double")
    want = set()
    for frame in {(r[0], r[1]) for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[:2] == frame), key=lambda r: (-(r[5] - r[3]) * (r[6] - r[4]), r[2])):
            if all(ratio(r[3:], k[3:]) < 0.25 for k in kept):
                kept.append(r)
        want |= {k[2] for k in kept}
    assert {r.key for r in boxes.suppressed(df.repartition(3), "frame", "key", 0.25).collect()} == want
    assert boxes.suppressed(df.limit(0), "frame", "key", 0.25).count() == 0
    crowd = spark.range(boxes.MOST_BOXES + 1).select(F.lit("f").alias("frame"), "id", *(F.lit(1.0).alias(c) for c in boxes.BOX))
    with pytest.raises(GateError, match="a frame has"):
        boxes.suppressed(crowd, "frame", "id", 0.5)


@pytest.mark.parametrize("cell", [3.0, 16.0, 1000.0])
def test_persistence_against_all_pairs(spark, cell):
    rows = made_boxes(2, 150)
    df = spark.createDataFrame(rows, "video string, at int, key int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.video, r["at"]): (r.n_seed, r.n_survived, round(r.persistence, 9), round(r.mean_ratio, 9)) for r in boxes.persistence(df, "video", "at", "key", 0.3, cell).collect()}
    want = {}
    for video in ("v0", "v1"):
        times = sorted({r[1] for r in rows if r[0] == video})
        for t, after in zip(times, times[1:]):
            best = [max(ratio(a[3:], b[3:]) for b in rows if b[0] == video and b[1] == after) for a in rows if a[:2] == (video, t)]
            survived = sum(x >= 0.3 for x in best)
            want[video, t] = (len(best), survived, round(survived / len(best), 9), round(sum(best) / len(best), 9))
    assert got == want


@pytest.mark.parametrize(("j", "s", "want"), [(0.8, 0.85, "LABEL"), (0.3, 0.9, "SCENE"), (0.2, 0.4, "NO_VERDICT"), (0.9, 0.6, "NO_VERDICT"), (None, 0.9, "NO_VERDICT")])
def test_persistence_verdict(spark, j, s, want):
    df = spark.createDataFrame([(j, s)], "j double, s double")
    assert df.select(boxes.persistence_verdict(F.col("j"), F.col("s"))).first()[0] == want


def test_group_weights_have_mean_one_over_labelled_rows(spark):
    rows = [("number", True)] * 3 + [("binary", True)] * 5 + [("number", False), (None, True), ("other", None)]
    df = spark.createDataFrame(rows, "g string, y boolean")
    got = losses.group_weights(df, "g", {"number": 4.0, "binary": 0.5}, F.col("y"))
    weights = [(r.g, r.y, r.weight) for r in got.collect()]
    labelled = [w for _, y, w in weights if y]
    assert np.mean(labelled) == pytest.approx(1.0)
    scale = 9 / (3 * 4 + 5 * 0.5 + 1)
    assert all(w == pytest.approx(scale * {"number": 4.0, "binary": 0.5}.get(g, 1.0)) for g, _, w in weights)
    assert {r.weight for r in losses.group_weights(df.filter("y = false"), "g", {"number": 4.0}, F.col("y")).collect()} == {4.0}
    for bad in ({"number": -1.0}, {"number": 0.0, "binary": 0.0}):
        with pytest.raises(GateError):
            losses.group_weights(df.filter("g in ('number', 'binary')"), "g", bad, F.col("y"))


def test_ordered_loss_and_wasserstein(spark):
    rng = np.random.default_rng(1)
    values = [0.0, 1.0, 4.0, 9.0]
    rows = [("a" if i % 2 else "b", [float(x) for x in rng.normal(0, 3, 4)], [0.0, 1.0, 4.0, 9.0, 5.0, None][i % 6]) for i in range(30)] + [("c", [1.0] * 4, None), ("d", None, 4.0)]
    df = spark.createDataFrame(rows, "k string, s array<double>, gold double")
    got = {r.k: (r.n, r.n_scored, r.ordered_loss) for r in losses.ordered_loss(df, "s", "gold", values, ["k"]).collect()}

    def loss(s, gold):
        p = np.exp(np.array(s) - max(s))
        return float((p / p.sum() * np.abs(np.array(values) - gold)).sum())

    for k in "ab":
        scored = [loss(s, g) for c, s, g in rows if c == k and g in values]
        assert got[k] == (15, len(scored), pytest.approx(np.mean(scored)))
    assert got["c"] == (1, 0, None) and "d" not in got
    with pytest.raises(GateError):
        losses.ordered_loss(spark.createDataFrame([("a", [1.0], 0.0)], df.schema), "s", "gold", values, ["k"])
    constant = spark.createDataFrame([([0.25] * 4, [0.25] * 4), ([1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0]), ([0.5, 0.5, 0.0, 0.0], [0.0, 0.5, 0.5, 0.0])], "a array<double>, b array<double>")
    places = F.array(*map(F.lit, values))
    assert [r[0] for r in constant.select(losses.wasserstein(F.col("a"), F.col("b"), places)).collect()] == pytest.approx([0.0, 9.0, 2.0])


def test_descriptors_against_numpy(spark):
    grid = np.random.default_rng(7).normal(size=(4, 6))
    descriptors.register(spark)
    frame = spark.createDataFrame([Row(i=1, g=[float(x) for x in grid.ravel()]), Row(i=2, g=[2.0] * 24), Row(i=3, g=None), Row(i=4, g=[1.0] * 23), Row(i=5, g=[])], "i int, g array<double>")
    frame.createOrReplaceTempView("grids_of_test")
    got = {(r.i, r.transform, r.descriptor): r.value for r in spark.sql("SELECT i, d.* FROM grids_of_test, LATERAL descriptors(g, 6) d").collect()}
    assert {k[0] for k in got} == {1, 2} and len(got) == 2 * len(descriptors.TRANSFORMS) * len(descriptors.NAMES)
    wide = np.pad(grid, 1, mode="edge")
    smooth = sum(wide[i : i + 4, j : j + 6] for i in range(3) for j in range(3)) / 9
    around = np.stack([wide[i : i + 4, j : j + 6] for i in range(3) for j in range(3)])
    half = (grid[::2, ::2] + grid[1::2, ::2] + grid[::2, 1::2] + grid[1::2, 1::2]) / 4
    for name, made in (("raw", grid), ("smooth", smooth), ("gradient", around.max(0) - around.min(0)), ("half", half)):
        assert got[1, name, "mean"] == pytest.approx(made.mean()) and got[1, name, "spread"] == pytest.approx(made.std())
        assert got[1, name, "high_share"] == pytest.approx((made > made.mean()).mean())
        across, down = np.abs(made[:, 1:] - made[:, :-1]), np.abs(made[1:] - made[:-1])
        assert got[1, name, "edges"] == pytest.approx((across.sum() + down.sum()) / (across.size + down.size))
        counts = np.histogram(made, 8)[0]
        shares = counts[counts > 0] / made.size
        assert got[1, name, "entropy"] == pytest.approx(-(shares * np.log2(shares)).sum())
    assert got[2, "raw", "entropy"] == 0 and got[2, "gradient", "mean"] == 0


def test_publishing_behind_gates(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = spark.range(100).select("id", (F.col("id") % 4).cast("string").alias("c"))
    gates = [
        publish.every_row("ids", F.col("id") >= 0), publish.share_between("fours", F.col("c") == "0", 0.2, 0.3), publish.rows_between("rows", 100, 100),
        publish.largest_share_at_most("classes", F.col("c"), ["0", "1", "2", "3"], 0.25, 4), publish.equal_sums("sums", F.col("id"), F.col("id")),
    ]
    with pytest.raises(FileNotFoundError):
        publish.published(spark, root)
    first = publish.publish(rows, root, gates)
    reader = publish.published(spark, root)
    assert reader.count() == 100
    for broken, what in ((rows.withColumn("id", -F.col("id")), "ids"), (rows.filter("c <> '0'"), "fours"), (rows.union(rows), "rows"), (rows.withColumn("c", F.lit("0")), "classes"), (rows.withColumn("id", F.when(F.col("id") > 0, F.col("id"))), "ids")):
        with pytest.raises(GateError, match=what):
            publish.publish(broken, root, gates)
        assert publish.current_version(spark, root) == first
    second = publish.publish(rows.limit(7), root, partition_by=["c"])
    assert publish.current_version(spark, root) == second
    assert reader.count() == 100 and publish.published(spark, root, first).count() == 100 and publish.published(spark, root).count() == 7
    assert publish.drop_versions(spark, root, keep=[first]) == [] and publish.drop_versions(spark, root) == [first]
    assert publish.published(spark, root).count() == 7
    assert publish.publish(rows.limit(0), root) != second and publish.published(spark, root).count() == 0


def test_gates_take_no_pass_of_their_own(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    publish.publish(spark.range(50).mapInArrow(counted, "id long"), str(tmp_path / "t"), [publish.every_row("ids", F.col("id") >= 0), publish.rows_between("rows", 50, 50)])
    assert seen.value == 50


def test_paired_verdict(spark):
    def told(**cells):
        df = spark.createDataFrame([(c, *x) for c, x in cells.items()], "cell string, point double, ci_low double, ci_high double")
        return tuple(comparing.paired_verdict(df).first())

    assert told(ALL=(0.02, 0.005, 0.03), ID=(0.0, -0.01, 0.01)) == ("", 0.02, "WIN")
    assert told(ALL=(0.02, 0.005, 0.03), ID=(-0.1, -0.2, -0.01)) == ("ID", 0.02, "HARM")
    assert told(ALL=(0.008, 0.005, 0.03)) == ("", 0.008, "NULL_RESULT")
    assert told(ALL=(0.05, -0.005, 0.1)) == ("", 0.05, "NULL_RESULT")
    assert told(ID=(0.05, 0.01, 0.1)) == ("", None, "NULL_RESULT")
    assert told(ALL=(0.05, None, None)) == ("", 0.05, "NULL_RESULT")


def test_policies(spark):
    df = spark.createDataFrame([(1, "ab", "ab", "a"), (2, "a", "ab", "a"), (3, "x", None, "x"), (4, None, "q", "q")], "k int, gold string, m string, n string")
    got = {r.policy: (r.n, r.n_right) for r in comparing.policies(df, "k", "gold", ["m", "n"]).collect()}
    assert got == {"m": (4, 1), "n": (4, 2), "shorter_m_n": (4, 2)}


@pytest.mark.parametrize(("text", "num", "whole"), [(" 7 ", 7.0, 7), ("7.", 7.0, 7), ("-2.9", -2.9, -2), ("1e3", 1000.0, 1000), ("7 .", None, None), ("", None, None), (None, None, None), ("NaN", None, None), ("about 7", None, None)])
def test_numbers_of_texts(spark, text, num, whole):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(answers.as_number(F.col("t")), answers.as_whole(F.col("t"))).first()) == (num, whole)


def test_chat_row_of_a_clip(spark):
    df = spark.createDataFrame([("When is it?", "00:01:10, 00:01:30", True), ("How long is it?", "00:00:12", True), ("How many?", "3", False)], "q string, a string, t boolean")
    lit = lambda x, kind: F.lit(x).cast(kind)
    row = lambda n: questions.chat_row("sys", F.col("q"), F.col("a"), F.col("t"), F.lit("v1"), lit(60, "double"), lit(10, "double"), lit(5, "int"), lit(2, "int"), 1.0, lit(n, "long"))
    got = [r.r for r in df.select(row(1000).alias("r")).collect()]
    assert [m.content for m in got[0].messages] == ["sys", "<video>Clip [00:01:00 - 00:01:10] of the procedure.\nWhen is it?", "00:00:10, 00:00:30"]
    assert got[0].videos == ["v1/60", "v1/65", "v1/70"] and got[0].raw_fps == 0.2
    assert (got[0].meta.k, got[0].meta.k_fine, got[0].meta.time_kind, got[0].meta.gold_original) == (3, 5, "2a_relative", "00:01:10, 00:01:30")
    assert (got[1].messages[2].content, got[1].meta.time_kind) == ("00:00:12", "2b_elapsed")
    assert (got[2].messages[2].content, got[2].meta.time_kind) == ("3", None)
    short = df.select(row(61).alias("r")).first().r
    assert short.videos == ["v1/60"] and short.raw_fps == 1.0


def test_every_pair_of_bits_is_a_flip():
    assert sorted(hamming.masks(4, 2)) == sorted({0, *(1 << i for i in range(4)), *((1 << i) | (1 << j) for i, j in combinations(range(4), 2))})
