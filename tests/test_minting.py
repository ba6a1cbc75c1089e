"""Minted negatives, probes and quota splits against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from gaugeworks.operators import minting, quotas, sampling
from gaugeworks.operators.gates import GateError

V = ["Clip", "Bag", "Mesh", "Loop", "Gauze"]
SHAPE = "frame string, kind string, a string, b string, n int, yes boolean"


def questions(spark, n=400, seed=1, classes=V[:4]):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        kind = rng.choice(["names", "count", "count", "both", "all_same"])
        a, b = rng.choice(classes), rng.choice(V)
        rows.append((f"f{rng.randrange(60):02d}", kind, a, b, rng.randrange(3), rng.random() < 0.3))
    return rows, spark.createDataFrame(rows, SHAPE).repartition(3)


def plain_inventory(rows):
    found = {f: set() for f, *_ in rows}
    for f, kind, a, _, n, _ in rows:
        if kind == "names" or kind == "count" and n > 0:
            found[f].add(a)
    return found


def plain_evidence(rows, named):
    present, absent, against = defaultdict(set), defaultdict(set), Counter()
    for f, kind, a, b, _, yes in rows:
        if kind == "both" and yes:
            present[f] |= {a, b}
        elif kind == "both" and (a in named[f]) != (b in named[f]):
            absent[f].add(b if a in named[f] else a)
        elif kind == "all_same" and yes:
            if len(named[f]) == 1:
                absent[f] |= set(V) - named[f]
            against[f] += len(named[f]) > 1
    return present, absent, against


def test_inventory_evidence_and_repair(spark):
    rows, df = questions(spark)
    named = plain_inventory(rows)
    inventory = minting.closure_inventory(df)
    assert {r.frame: set(r.named) for r in inventory.collect()} == named
    present, absent, against = plain_evidence(rows, named)
    evidence = minting.binary_evidence(df, inventory, V)
    for r in evidence.collect():
        assert (set(r.present), set(r.absent), r.contradictions) == (present[r.frame], absent[r.frame], against[r.frame])
    got = {r.frame: (set(r.named), r.repaired) for r in minting.repair(inventory, evidence).collect()}
    assert got == {f: (x | present[f], len(present[f] - x)) for f, x in named.items()}
    with pytest.raises(GateError, match="vocabulary"):
        minting.binary_evidence(df.withColumn("b", F.lit("Fork")), inventory, V).count()


def test_mint_by_dose_share_cap_and_evidence(spark):
    rows, df = questions(spark, 900)
    rule = minting.MintRule(dose_ratio=4.0, unseen_share=0.25, max_per_frame=2, seed=3)
    made = minting.mint(df, V, rule)
    got = made.rows.collect()
    named = plain_inventory(rows)
    present, *_ = plain_evidence(rows, named)
    named = {f: x | present[f] for f, x in named.items()}
    _, absent, _ = plain_evidence(rows, named)
    asked = Counter(a for _, kind, a, *_ in rows if kind == "count")
    assert made.target == round(sum(asked.values()) / 4)
    assert made.n_repaired == sum(len(x - plain_inventory(rows)[f]) for f, x in named.items())
    pool = [(f, c) for f, x in named.items() if x for c in V if c not in x]
    assert (made.n_seen_pool, made.n_unseen_pool) == (sum(c in asked for _, c in pool), sum(c not in asked for _, c in pool))
    assert len({(r.frame, r["class"]) for r in got}) == len(got)
    for r in got:
        assert (r.frame, r["class"]) in pool and r.answer == 0 and r.named == ", ".join(sorted(named[r.frame]))
        assert r.seen_class == (r["class"] in asked) and r.evidence == ("binary" if r["class"] in absent[r.frame] else "closure")
    assert max(Counter(r.frame for r in got).values()) <= 2
    wide = minting.mint(df, V, minting.MintRule(dose_ratio=4.0, unseen_share=0.25, max_per_frame=99, seed=3)).rows.collect()
    unseen = min(round(made.target * 0.25), made.n_unseen_pool)
    assert sum(not r.seen_class for r in wide) == unseen and len(wide) == min(made.target - unseen, made.n_seen_pool) + unseen
    first = {f: sorted(r["class"] for r in wide if r.frame == f)[:2] for f in named}
    assert {(r.frame, r["class"]) for r in got} == {(f, c) for f, cs in first.items() for c in cs}
    again = minting.mint(df.repartition(7), V, rule).rows.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert minting.mint(df.limit(0), V, rule).rows.count() == 0


def test_weights_favour_the_dominant_and_the_rare(spark):
    rows = [("f", "count", c, None, 1, None) for c, n in (("Clip", 150), ("Bag", 120), ("Mesh", 3)) for _ in range(n)]
    got = {r["class"]: (r.n, r.weight) for r in minting.class_weights(spark.createDataFrame(rows, SHAPE), V, minting.MintRule()).collect()}
    assert got == {"Clip": (150, 6.0), "Bag": (120, 1.0), "Mesh": (3, 3.0), "Loop": (0, None), "Gauze": (0, None)}
    drawn = Counter()
    for seed in range(3):
        pool = spark.range(6000).select((F.col("id") % 2).alias("heavy"), F.col("id").alias("key"), F.pow(sampling.uniform(seed, "x", F.col("id")), 1.0 / F.when(F.col("id") % 2 == 1, 6.0).otherwise(1.0)).alias("score"))
        drawn.update(r.heavy for r in sampling.exactly_k(pool, "score", ["key"], 300).collect())
    assert sum(drawn.values()) == 900 and drawn[1] > 4 * drawn[0]


def test_dose_mix_and_plural_gates(spark):
    df = spark.createDataFrame([("x",)] * 90, "a string")
    assert minting.dose_holds(df, 100).count() == 90
    for target in (101, 80, 0):
        with pytest.raises(GateError, match="dose"):
            minting.dose_holds(df, target)
    nouns = spark.createDataFrame([("Clips",), ("External drains",), ("Meshes",)], "noun string")
    assert minting.plurals_match(nouns, "noun", ["Clip", "External Drain", " mesh "]).count() == 3
    with pytest.raises(GateError, match="rule"):
        minting.plurals_match(nouns, "noun", ["Clip", "External Drain"])


def test_probe_set_is_balanced(spark):
    rows, df = questions(spark, 300)
    named = plain_inventory(rows)
    frames = spark.createDataFrame([(f, "ID" if f < "f30" else "OOD") for f in named], "frame string, side string")
    got = minting.probe_set(df, frames, V, "side", 10, seed=5).collect()
    usable = {f for f, x in named.items() if 0 < len(x) < len(V)}
    assert Counter(r.side for r in got) == {s: 4 * min(10, sum((f < "f30") == (s == "ID") for f in usable)) for s in ("ID", "OOD")}
    for r in got:
        assert r.frame in usable and (r["class"] in named[r.frame]) == (r.arm == "present")
    assert set(Counter((r.frame, r.arm, r.fmt) for r in got).values()) == {1}


@pytest.mark.parametrize("few", [0, 3, 5000])
def test_exactly_k_against_sorting(spark, few):
    rng = random.Random(few)
    rows = [(i, rng.choice([0.5, 0.25, rng.random()])) for i in range(500)] + [(900, None), (901, None)]
    df = spark.createDataFrame(rows, "key int, s double").repartition(4)
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))
    for k in (0, 1, 7, 120, 250, 499, 500, 900):
        got = sampling.exactly_k(df, "s", ["key"], k, few).collect()
        assert len(got) == min(k, 500) and len({r.key for r in got}) == len(got)
        assert sorted(r.s for r in got) == sorted(r[1] for r in order[:k])
        if few == 5000:
            assert {r.key for r in got} == {r[0] for r in order[:k]}
    assert sampling.exactly_k(df.limit(0), "s", ["key"], 5, few).count() == 0


@pytest.mark.parametrize("cells", [1, 3, 10_000])
def test_lowest_per_cell_against_windows(spark, cells):
    """A third of the rows and more in one cell, null cells and cells of one row among them."""
    from pyspark.sql import Window

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 50).cast("string")).alias("c"), F.col("id").alias("key"))
    order = F.md5(F.col("key").cast("string"))
    for quota in (lambda n: F.bround(n * F.lit(0.1), 0), lambda n: F.least(n, F.lit(5)), lambda n: n, lambda n: n * 0):
        w = Window.partitionBy("c")
        want = df.withColumn("p", F.row_number().over(w.orderBy(order, "key"))).withColumn("n", F.count(F.lit(1)).over(w)).filter(F.col("p") <= quota(F.col("n"))).select("key")
        got = sampling.lowest_per_cell(df, ["c"], order, ["key"], quota, cells)
        assert got.columns == df.columns
        assert sorted(r.key for r in got.collect()) == sorted(r.key for r in want.collect())
    even = sampling.lowest_per_cell(df, ["c"], F.lit("00000000"), ["key"], lambda n: F.least(n, F.lit(2)), cells)  # draws that are all alike
    assert even.groupBy("c").count().agg(F.max("count")).first()[0] <= 2


def plain_deal(masses, counts, shares):
    exact = [Fraction(str(x)) for x in shares]
    got, mass, out = [0] * len(counts), [0] * len(counts), []
    for m in masses:
        able = [k for k in range(len(counts)) if got[k] < counts[k]]
        total = sum(mass[k] for k in able) + m
        k = min(able, key=lambda k: (Fraction(mass[k], total) if total else Fraction(0)) - (exact[k] / sum(exact[c] for c in able) if total else 0))
        out.append(k)
        got[k] += 1
        mass[k] += m
    return out


def dealt(masses, counts, shares):
    runs = [(m, n) for m, n in sorted(Counter(masses).items(), reverse=True)]
    return [p[i % len(p)] for _, first, last, p in quotas.deal_runs(runs, counts, shares) for i in range(last - first + 1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=120), st.sampled_from([(0.6, 0.2, 0.2), (0.8, 0.2), (0.65, 0.35), (0.5, 0.25, 0.125, 0.125), (0.333, 0.667)]))
def test_runs_are_dealt_as_one_by_one(masses, shares):
    names = [(str(k), s) for k, s in enumerate(shares)]
    counts = list(quotas.quota_counts(len(masses), names, "0").values())
    if min(counts) >= 0:
        assert dealt(masses, counts, shares) == plain_deal(sorted(masses, reverse=True), counts, shares)


def test_runs_without_a_return_are_dealt_too(monkeypatch):
    monkeypatch.setattr(quotas, "PATIENCE", 3)
    masses = [5] * 90 + [3] * 50 + [2] * 40
    shares = (0.617, 0.383)
    assert dealt(masses, [111, 69], shares) == plain_deal(masses, [111, 69], shares)
    with pytest.raises(GateError):
        dealt([1, 1, 1], [1, 1], (0.5, 0.5))


def test_a_billion_equal_clusters_are_a_few_steps():
    found = list(quotas.deal_runs([(7, 10**9)], [6 * 10**8, 2 * 10**8, 2 * 10**8], (0.6, 0.2, 0.2)))
    assert len(found) < 5 and found[-1][2] == 10**9


def test_mass_split_on_a_table(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), f"v{i:03d}", rng.choice([0, 1, 1, 1, 4, 9]) if i % 50 else None) for i in range(300)]
    df = spark.createDataFrame([Row(stratum=s, cluster=c, m=m, split_of="x") for s, c, m in rows], "stratum string, cluster string, m int, split_of string")
    shares = {"train": 0.6, "val": 0.2, "test": 0.2}
    split = quotas.mass_split(df.repartition(3), "cluster", "m", shares, "train", "stratum", seed=1)
    assert split.columns == [*df.columns, "split"]
    got = {r.cluster: r.split for r in split.collect()}
    order = {r.cluster: r.o for r in df.select("cluster", quotas.order_key(1, "split", F.col("cluster")).alias("o")).collect()}
    for s in "ab":
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (-(r[2] or 0), order[r[1]], r[1]))
        counts = quotas.quota_counts(len(mine), list(shares.items()), "train")
        want = plain_deal([r[2] or 0 for r in mine], list(counts.values()), list(shares.values()))
        assert [got[r[1]] for r in mine] == [list(shares)[k] for k in want]
    whole = quotas.mass_split(df, "cluster", "m", {"a": 0.5, "b": 0.5}, "a", counts={"a": 150, "b": 150}, seed=1)
    quotas.counts_hold(whole, {"a": 150, "b": 150})
    with pytest.raises(GateError):
        quotas.counts_hold(whole, {"a": 151, "b": 149})
    quotas.drift_at_most(whole, "b", 0.5, {"m": 0.03})
    with pytest.raises(GateError, match="off its share"):
        quotas.drift_at_most(whole, "b", 0.1, {"m": 0.03})
    assert quotas.mass_split(df.limit(0), "cluster", "m", shares, "train", "stratum").count() == 0
    assert quotas.mass_split(df.limit(0), "cluster", "m", {"a": 0.5, "b": 0.5}, "a", counts={"a": 0, "b": 0}).count() == 0
