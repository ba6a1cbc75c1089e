"""Splits of whole clusters by count quotas, balanced by mass: heaviest first, run by run.

Each cluster goes to the part that lies furthest below its share of the mass dealt so
far; a part that has its quota of clusters takes no more.  That is sequential, but
clusters of equal mass are alike: the steps see a run of them, and as the deficits of the
parts return to where they were after some steps (shares are fractions), a run is a few
steps, a pattern and how often it comes.  So what is dealt one after the other are the
distinct masses of a stratum, not its clusters; these look up their place in the run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from fractions import Fraction
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.draws import order_key
from gaugeworks.operators.gates import GateError
from gaugeworks.operators.ranges import place_within

#: Distinct masses of a stratum at most.
MOST_MASSES = 2_000_000
#: Steps of a run that are kept while waiting for the deficits to return.
PATIENCE = 10_000


def quota_counts(n: int, shares: Sequence[tuple[str, float]], rest: str) -> dict[str, int]:
    """Clusters of each part of n: rounded shares (half to even), what is left or too much goes to ``rest``."""
    counts = {name: round(n * share) for name, share in shares}
    counts[rest] += n - sum(counts.values())
    return counts


def deal_runs(runs: Iterable[tuple[int, int]], counts: Sequence[int], shares: Sequence[float]) -> Iterator[tuple[int, int, int, list[int]]]:
    """(mass, first, last, pattern) for runs of (mass, clusters), heaviest first.

    The clusters at places ``first`` to ``last`` (from 1) of a run go to the parts of the
    pattern, again and again.  Whole numbers throughout: a part's deficit is its share of
    the mass dealt, this cluster's with it, less what it has; the largest deficit takes
    the cluster, and of equal ones the part that is named first.
    """
    exact = [Fraction(str(x)) for x in shares]
    common = lcm(*(x.denominator for x in exact))
    whole = [int(x * common) for x in exact]
    got, mass = [0] * len(counts), [0] * len(counts)
    for m, n in runs:
        at = 0
        while at < n:
            open_parts = [k for k in range(len(counts)) if got[k] < counts[k]]
            if not open_parts:
                raise GateError("there are more clusters than the quotas hold")
            if len(open_parts) == 1:
                k = open_parts[0]
                took = min(n - at, counts[k] - got[k])
                yield m, at + 1, at + took, [k]
                got[k], mass[k], at = got[k] + took, mass[k] + took * m, at + took
                continue
            shared = sum(whole[k] for k in open_parts)
            dealt = sum(mass[k] for k in open_parts)
            start, steps = at, []
            seen = {tuple(whole[k] * dealt - shared * mass[k] for k in open_parts): 0}
            room = {k: counts[k] - got[k] for k in open_parts}
            while at < n:
                dealt += m
                k = max(open_parts, key=lambda k: whole[k] * dealt - shared * mass[k])  # the first of equal ones
                steps.append(k)
                mass[k] += m
                room[k] -= 1
                at += 1
                if not room[k]:
                    break
                now = tuple(whole[k] * dealt - shared * mass[k] for k in open_parts)
                if now in seen:
                    pattern = steps[seen[now] :]
                    times = min([(n - at) // len(pattern), *((room[k] - 1) // pattern.count(k) for k in open_parts if k in pattern)])
                    if times > 0:
                        head = start + seen[now]
                        if head > start:
                            yield m, start + 1, head, steps[: head - start]
                        at += times * len(pattern)
                        yield m, head + 1, at, pattern
                        for k in open_parts:
                            took = times * pattern.count(k)
                            mass[k], room[k], dealt = mass[k] + took * m, room[k] - took, dealt + took * m
                        start, steps, seen = at, [], {}
                        continue
                if len(seen) < PATIENCE:
                    seen[now] = len(steps)
                elif len(steps) >= 2 * PATIENCE:  # no return yet: hand on what there is
                    yield m, start + 1, at, steps
                    start, steps, seen = at, [], {now: 0}
            if steps:
                yield m, start + 1, at, steps
            for k in open_parts:
                got[k] = counts[k] - room[k]


def mass_split(clusters: DataFrame, cluster: str, mass: str, shares: dict[str, float], rest: str, stratum: str | None = None, counts: dict[str, int] | None = None, seed: int = 0) -> DataFrame:
    """``clusters`` (one row each) with ``split``.

    ``shares`` in the order in which equal deficits are settled; quotas are the rounded
    shares of a stratum's clusters, or ``counts`` for a table without strata.  Clusters of
    equal mass stand in hashed order.  Masses are whole numbers; one without mass counts
    as 0.  A stratum's distinct masses are one task, and raise beyond ``MOST_MASSES``.
    """
    names, of = list(shares), list(shares.values())
    group = stratum or "_all"
    rows = clusters.withColumn("_mass", F.coalesce(F.col(mass), F.lit(0)).cast("long")).withColumn("_order", order_key(seed, "split", F.col(cluster)))
    if stratum is None:
        rows = rows.withColumn(group, F.lit(0))
    runs = rows.groupBy(group, "_mass").agg(F.count(F.lit(1)).alias("_n"))
    most = runs.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    if most > MOST_MASSES:
        raise ValueError(f"a stratum has {most} distinct masses, at most {MOST_MASSES} are dealt")

    def dealt(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_mass", ascending=False)
        held = counts or quota_counts(int(pdf["_n"].sum()), list(shares.items()), rest)
        found = deal_runs(zip(pdf["_mass"].tolist(), pdf["_n"].tolist(), strict=True), [held[k] for k in names], of)
        made = pd.DataFrame(list(found), columns=["_m", "_first", "_last", "_pattern"])
        return made.assign(**{group: pdf[group].iloc[0]})[[group, "_m", "_first", "_last", "_pattern"]]

    kind = rows.schema[group].dataType.simpleString()
    ddl = f"{group} {kind}, _m long, _first long, _last long, _pattern array<int>"
    if stratum is None:  # its distinct masses are few: dealt here
        held = runs.toPandas()
        segments = clusters.sparkSession.createDataFrame(dealt(held) if len(held) else pd.DataFrame(columns=[group, "_m", "_first", "_last", "_pattern"]), ddl)
    else:
        segments = runs.groupBy(group).applyInPandas(dealt, ddl)
    placed = place_within(rows, [group, "_mass"], ["_order", cluster], "_at").alias("p")
    met = placed.join(segments.alias("s"), F.col(f"p.{group}").eqNullSafe(F.col(f"s.{group}")) & (F.col("_mass") == F.col("_m")) & F.col("_at").between(F.col("_first"), F.col("_last")))
    part = F.element_at("_pattern", ((F.col("_at") - F.col("_first")) % F.size("_pattern") + 1).cast("int"))
    return met.select(*(F.col(f"p.{c}") for c in clusters.columns), F.element_at(F.array(*map(F.lit, names)), part + 1).alias("split"))


def drift_at_most(split: DataFrame, part: str, share: float, limits: dict[str, float]) -> DataFrame:
    """Raises where a part's share of a mass is further from its share than the limit of that mass; the table is handed on."""
    sums = split.agg(*(F.sum(F.when(F.col("split") == part, F.col(c))).alias(f"in_{c}") for c in limits), *(F.sum(c).alias(c) for c in limits)).first()
    for c, most in limits.items():
        if sums[c]:
            held = (sums[f"in_{c}"] or 0) / sums[c]
            if abs(held - share) > most:
                raise GateError(f"{part} holds {held:.3f} of {c}, more than {most} off its share {share:.3f}")
    return split


def counts_hold(split: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Raises unless the parts have exactly these numbers of clusters."""
    found = dict(split.groupBy("split").count().collect())
    if found != {k: n for k, n in counts.items() if n}:
        raise GateError(f"the split is {found}, not {counts}")
    return split
