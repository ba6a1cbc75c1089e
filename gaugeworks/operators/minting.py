"""Negative items from what frames don't show: closure inventory, a second channel of evidence, weighted draws.

A frame is asked about in four ways: what classes it shows (``names``), how many of one
class (``count``), whether it shows two classes (``both``), whether all it shows is of one
class (``all_same``).  The first two give an inventory, from which a class that is not
named counts as absent.  The other two never enter it, so they can refute an absence
(the inventory is repaired before anything is drawn) or prove one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.draws import order_key, uniform
from gaugeworks.operators.gates import GateError, require
from gaugeworks.operators.sampling import exactly_k, lowest_per_cell
from gaugeworks.sources import folders


@dataclass(frozen=True)
class MintRule:
    """How many negatives there are for each real count item, and how they are spread.

    ``dose_ratio``: count items for one negative; ``unseen_share``: share of negatives, at
    most, of classes that no count item asks for; ``max_per_frame``: negatives of a frame;
    ``w_dominant``, ``w_rare``: added to the weight 1 of the class asked for most, and of
    classes asked for fewer than ``rare_below`` times.
    """

    dose_ratio: float = 2.5
    unseen_share: float = 0.10
    max_per_frame: int = 2
    w_dominant: float = 5.0
    w_rare: float = 2.0
    rare_below: int = 100
    seed: int = 42


def literal(names: Sequence[str]) -> Column:
    return F.array(*(F.lit(x) for x in names)) if names else F.array().cast("array<string>")


def closure_inventory(questions: DataFrame) -> DataFrame:
    """frame, named (sorted classes) for every frame that was asked about; a count names its class if it is positive.

    ``questions``: frame, kind, a, b, n (the count), yes.
    """
    shown = F.when((F.col("kind") == "names") | (F.col("kind") == "count") & (F.col("n") > 0), F.col("a"))
    return questions.groupBy("frame").agg(F.array_sort(F.collect_set(shown)).alias("named"))


def binary_evidence(questions: DataFrame, inventory: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """frame, present, absent, contradictions, from ``both`` and ``all_same`` alone.

    Both shown: both are present.  Not both, one of them in the inventory: the other one is
    absent.  All of one class, and the inventory names one: every other is absent; where
    it names several, the answers contradict each other.  Raises where a class is not in
    the vocabulary, as a half-read channel would weaken every filter after it.
    """
    classes = literal(vocabulary)
    pairs = questions.filter("kind = 'both' and yes is not null")
    require(pairs, "classes outside the vocabulary", F.array_contains(classes, F.col("a")) & F.array_contains(classes, F.col("b")))
    asked = questions.filter("kind in ('both', 'all_same') and yes is not null").join(inventory, "frame")
    has_a, has_b = F.array_contains("named", F.col("a")), F.array_contains("named", F.col("b"))
    both, one = F.col("kind") == "both", F.size("named") == 1
    none = F.array().cast("array<string>")
    present = F.when(both & F.col("yes"), F.array("a", "b")).otherwise(none)
    absent = (
        F.when(both & ~F.col("yes") & has_a & ~has_b, F.array("b"))
        .when(both & ~F.col("yes") & has_b & ~has_a, F.array("a"))
        .when(~both & F.col("yes") & one, F.array_except(classes, F.col("named")))
        .otherwise(none)
    )
    against = (~both & F.col("yes") & (F.size("named") > 1)).cast("long")
    facts = asked.select("frame", against.alias("against"), F.explode_outer(F.concat(F.transform(present, lambda c: F.struct(c.alias("c"), F.lit(True).alias("p"))), F.transform(absent, lambda c: F.struct(c.alias("c"), F.lit(False).alias("p"))))).alias("fact"))
    # No more than the vocabulary is gathered for a frame; contradictions have no facts, so each is one row.
    return facts.groupBy("frame").agg(
        F.array_sort(F.collect_set(F.when(F.col("fact.p"), F.col("fact.c")))).alias("present"),
        F.array_sort(F.collect_set(F.when(~F.col("fact.p"), F.col("fact.c")))).alias("absent"),
        F.sum("against").alias("contradictions"),
    )


def repair(inventory: DataFrame, evidence: DataFrame) -> DataFrame:
    """The inventory with the classes that the evidence shows to be present, and how many were added."""
    known = F.coalesce("present", F.array().cast("array<string>"))
    both = inventory.join(evidence.select("frame", "present"), "frame", "left")
    return both.select("frame", F.array_sort(F.array_union("named", known)).alias("named"), F.size(F.array_except(known, F.col("named"))).cast("long").alias("repaired"))


def class_weights(questions: DataFrame, vocabulary: Sequence[str], rule: MintRule) -> DataFrame:
    """class, n (count items that ask for it), weight; NULL for classes that none asks for.  A row for each class of the vocabulary."""
    counted = questions.filter("kind = 'count'").groupBy(F.col("a").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    every = questions.sparkSession.createDataFrame([(c,) for c in vocabulary], "class string").join(counted, "class", "left")
    top = F.max("n").over(Window.partitionBy(F.lit(1)))
    weight = 1.0 + F.when(F.col("n") == top, F.lit(rule.w_dominant)).otherwise(0.0) + F.when(F.col("n") < rule.rare_below, F.lit(rule.w_rare)).otherwise(0.0)
    return every.select("class", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, weight).alias("weight"))


@dataclass(frozen=True)
class Minted:
    """Negatives, and the figures their gates ask for."""

    rows: DataFrame
    target: int
    n_seen_pool: int
    n_unseen_pool: int
    n_repaired: int
    contradictions: int


def mint(questions: DataFrame, vocabulary: Sequence[str], rule: MintRule | None = None) -> Minted:
    """Negatives: frame, class, answer 0, named, seen_class, evidence (``binary`` where the second channel proves the absence, else ``closure``).

    Candidates are the classes that a frame with an inventory does not name after its
    repair.  Of those of classes that count items ask for, and of the rest, exactly as many
    are drawn as the dose and the capped share say, without replacement and by weight (the
    largest u ** (1 / w)); the cuts are found by counting, so no task or driver sees all
    candidates in order.  After the draw a frame keeps its first ``max_per_frame`` classes.
    Frames without an inventory give nothing; an empty table gives an empty result.
    """
    rule = rule or MintRule()
    inventory = closure_inventory(questions)
    first = binary_evidence(questions, inventory, vocabulary)
    repaired = written(repair(inventory, first), "inventory")
    evidence = binary_evidence(questions, repaired.drop("repaired"), vocabulary)
    weights = class_weights(questions, vocabulary, rule)
    asked = weights.agg(F.sum("n")).first()[0] or 0
    target = round(asked / rule.dose_ratio)
    absent = repaired.filter(F.size("named") > 0).select("frame", "named", F.explode(F.array_except(literal(vocabulary), F.col("named"))).alias("class"))
    u = uniform(rule.seed, "mint", F.col("frame"), F.col("class"))
    scored = absent.join(F.broadcast(weights), "class").select("frame", "class", "named", F.col("weight").isNotNull().alias("seen_class"), F.pow(u, 1.0 / F.coalesce("weight", F.lit(1.0))).alias("score"))
    pool = written(scored, "candidates")
    sizes = dict(pool.groupBy("seen_class").count().collect())
    n_unseen = min(round(target * rule.unseen_share), sizes.get(False, 0))
    n_seen = min(target - n_unseen, sizes.get(True, 0))
    ties = ["frame", "class"]
    picked = exactly_k(pool.filter("seen_class"), "score", ties, n_seen).unionByName(exactly_k(pool.filter("not seen_class"), "score", ties, n_unseen))
    place = F.row_number().over(Window.partitionBy("frame").orderBy("class"))  # a frame has no more than the vocabulary
    kept = picked.withColumn("place", place).filter(F.col("place") <= rule.max_per_frame)
    proven = evidence.select("frame", "absent")
    confirmed = F.coalesce(F.array_contains("absent", F.col("class")), F.lit(False))
    rows = kept.join(proven, "frame", "left").select(
        "frame", "class", F.lit(0).alias("answer"), F.array_join("named", ", ").alias("named"), "seen_class", F.when(confirmed, "binary").otherwise("closure").alias("evidence")
    )
    n_repaired = repaired.agg(F.coalesce(F.sum("repaired"), F.lit(0))).first()[0]
    against = evidence.agg(F.coalesce(F.sum("contradictions"), F.lit(0))).first()[0]
    return Minted(rows, target, sizes.get(True, 0), sizes.get(False, 0), n_repaired, against)


def written(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder, as it is read several times."""
    path = folders.fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dose_holds(rows: DataFrame, target: int, tolerance: float = 0.10) -> DataFrame:
    """Raises unless as many rows were made as were asked for, within a tolerance."""
    if target <= 0:
        raise GateError(f"the dose asked for is {target}")
    n = rows.count()
    if abs(n - target) > tolerance * target:
        raise GateError(f"{n} rows for a dose of {target}")
    return rows


def plural(name: Column) -> Column:
    """The plural by rule: the name in sentence case, with ``es`` after a hiss, else ``s``."""
    trimmed = F.trim(name)
    said = F.concat(F.upper(F.substring(trimmed, 1, 1)), F.lower(F.substring(trimmed, 2, 1 << 20)))
    return F.concat(said, F.when(F.lower(trimmed).rlike("(s|sh|ch|x|z)$"), "es").otherwise("s"))


def plurals_match(asked: DataFrame, noun: str, vocabulary: Sequence[str]) -> DataFrame:
    """Raises where count items use a noun that is no plural, by rule, of a class; returns noun, n."""
    by_rule = asked.sparkSession.createDataFrame([(c,) for c in vocabulary], "c string").select(plural(F.col("c")).alias(noun))
    found = asked.groupBy(noun).agg(F.count(F.lit(1)).alias("n"))
    bad = found.join(F.broadcast(by_rule), noun, "left_anti").limit(5).collect()
    if bad:
        raise GateError(f"nouns that the rule doesn't give: {[r[noun] for r in bad]}")
    return found


def probe_set(questions: DataFrame, frames: DataFrame, vocabulary: Sequence[str], by: str, per_cell: int, formats: Sequence[str] = ("number", "binary"), seed: int = 0) -> DataFrame:
    """Balanced probe: an absent and a present class of each chosen frame, asked for in every format.

    ``per_cell`` frames of each cell ``by`` (a column of ``frames``, one row a frame), those
    with the least draws; frames that name nothing or everything can't be asked both ways.
    """
    usable = closure_inventory(questions).filter((F.size("named") > 0) & (F.size("named") < len(vocabulary))).join(frames.select("frame", by), "frame")
    chosen = lowest_per_cell(usable, [by], order_key(seed, "probe", F.col("frame")), ["frame"], lambda n: F.least(n, F.lit(per_cell)))
    others = F.array_except(literal(vocabulary), F.col("named"))

    def drawn(options: Column, arm: str) -> Column:
        at = F.floor(uniform(seed, arm, F.col("frame")) * F.size(options)).cast("int") + 1
        return F.struct(F.lit(arm).alias("arm"), F.element_at(options, at).alias("class"))

    arms = F.explode(F.array(drawn(others, "absent"), drawn(F.col("named"), "present")))
    asked = chosen.select("frame", by, F.array_join("named", ", ").alias("named"), arms.alias("q"))
    return asked.withColumn("fmt", F.explode(literal(formats))).select("frame", by, F.col("q.class").alias("class"), F.col("q.arm").alias("arm"), "fmt", "named")
