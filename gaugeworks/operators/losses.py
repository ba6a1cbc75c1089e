"""Weights of rows by group, and a loss that knows how far a wrong class is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.gates import GateError, require


def group_weights(rows: DataFrame, group: str, weights: dict[str, float], labelled: Column, name: str = "weight") -> DataFrame:
    """``rows`` with a weight each, such that the labelled ones have weight 1 on the mean.

    A group that ``weights`` doesn't name (or a null one) weighs 1; rows that aren't labelled
    get their group's weight on the same scale, but have no part in it.  One pass of sums,
    whose single row is joined on.  Raises for a negative weight, and where all labelled
    rows weigh nothing; a table without labelled rows keeps its weights as they are.
    """
    if any(w < 0 for w in weights.values()):
        raise GateError("a negative weight turns a gradient round")
    own = F.lit(1.0)
    for g, w in weights.items():
        own = F.when(F.col(group) == F.lit(g), F.lit(float(w))).otherwise(own)
    is_labelled = F.coalesce(labelled, F.lit(False))
    weighed = rows.withColumn(name, own).withColumn("_labelled", is_labelled)
    n, total = weighed.agg(F.count_if("_labelled"), F.sum(F.when(F.col("_labelled"), F.col(name)))).first()
    if n and total <= 0:
        raise GateError("the labelled rows weigh nothing")
    return weighed.withColumn(name, F.col(name) * F.lit(n / total if n else 1.0)).drop("_labelled")


def share_of(rows: DataFrame, group: str, weight: str, labelled: Column) -> DataFrame:
    """group, n, share of the labelled weight."""
    done = rows.filter(labelled).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    total = done.agg(F.sum("w").alias("all"))
    return done.crossJoin(F.broadcast(total)).select(group, "n", (F.col("w") / F.col("all")).alias("share"))


def softmax(scores: Column) -> Column:
    """Shares of an array of scores; null for a null or empty one."""
    top = F.array_max(scores)
    raised = F.array(F.transform(scores, lambda x: F.exp(x - top)))  # in an array of one, so that it is made once
    summed = F.transform(raised, lambda r: F.struct(r.alias("r"), F.aggregate(r, F.lit(0.0), lambda s, y: s + y).alias("s")))
    return F.transform(summed, lambda t: F.transform(t["r"], lambda x: x / t["s"]))[0]


def distance_to_point(shares: Column, values: Column, gold: Column) -> Column:
    """1-D Wasserstein distance of a distribution over ``values`` to all of it at ``gold``: what lies where, times how far."""
    far = F.zip_with(shares, values, lambda p, v: p * F.abs(v - gold))
    return F.aggregate(far, F.lit(0.0), lambda s, x: s + x)


def wasserstein(a: Column, b: Column, values: Column) -> Column:
    """1-D Wasserstein distance of two distributions over the same rising ``values``: the area between their running totals."""
    apart = F.zip_with(a, b, lambda x, y: x - y)
    start = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("level"), F.lit(None).cast("double").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        reached = acc["area"] + F.coalesce(F.abs(acc["level"]) * (x["v"] - acc["at"]), F.lit(0.0))
        return F.struct(reached.alias("area"), (acc["level"] + x["d"]).alias("level"), x["v"].alias("at"))

    return F.aggregate(F.zip_with(apart, values, lambda d, v: F.struct(d.cast("double").alias("d"), v.cast("double").alias("v"))), start, step)["area"]


def ordered_loss(rows: DataFrame, scores: str, gold: str, values: list[float], by: list[str], weight: str | None = None) -> DataFrame:
    """by, n, n_scored, ordered_loss: the mean distance of the softmax over ``values`` to the gold value.

    Rows whose gold is null or none of the values have no part (``n`` counts them all);
    a cell without any other has a NULL loss.  With ``weight`` the mean is a weighted one.
    """
    places = F.array(*(F.lit(float(v)) for v in values))
    sized = require(rows.filter(F.col(scores).isNotNull()), f"{scores} that are not {len(values)} long", F.size(scores) == len(values))
    gold_value = F.col(gold).cast("double")
    loss = F.when(F.array_contains(places, gold_value), distance_to_point(softmax(F.col(scores)), places, gold_value))
    w = F.col(weight) if weight else F.lit(1.0)
    scored = sized.withColumn("_loss", loss)
    has = F.col("_loss").isNotNull()
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count("_loss").alias("n_scored"), F.try_divide(F.sum(F.when(has, F.col("_loss") * w)), F.sum(F.when(has, w))).alias("ordered_loss")
    )
