"""Mixing sources to target weights.

Temperature mixing: source shares p are raised to an exponent and normalised.  The
exponent is found by bisection, so that the mixture has a target entropy or repeats
no source more often than allowed; the sums it needs are aggregates, so only single
numbers come to the driver.  The weights are realised as budgeted block permutations:
every source is permuted anew for each pass over it, as many documents are taken as
its part of the budget holds, and the mixture is cut into blocks in which all sources
progress alike.

DataFrame functions only.  A hot source is never one task: its permutation is dealt
into buckets by the leading bits of the draw, which are ordered and summed each by
itself; sums over bucket totals place them.
"""

from __future__ import annotations

from math import ceil, exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import COPIES, numbered_copies
from .storage import materialise
from .tables import free_names, row_digest

MAX_REPEATS = 1.25
BLOCK_TOKENS = 1_000_000
BUCKET_DOCS = 500
POINTS = 16
NO_SOURCE = "<null>"
#: Sources that are broadcast at most; beyond that their table is joined by shuffling.
BROADCAST_SOURCES = 10_000


def word_tokens(text: Column) -> Column:
    """Words of the text, and one for the end of the document."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def draw(*parts: Column) -> Column:
    """A 32-bit number from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def source_totals(rows: DataFrame) -> DataFrame:
    """source, source_tokens, source_docs of rows (doc_id, source, n_tokens)."""
    return rows.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))


def _at(totals: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float]]:
    """Entropy of the mixture, and repeats of the most repeated source per token of budget, at each exponent."""
    share = F.col("source_tokens") / F.lit(float(total))
    sums = []
    for a in exponents:
        sums += [F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)), F.max(F.pow(share, F.lit(a - 1.0)))]
    got = totals.filter("source_tokens > 0").agg(*sums).first()
    return [(log(z) - a * pl / z, most / z / total) for a, z, pl, most in zip(exponents, got[::3], got[1::3], got[2::3], strict=True)]


def find_exponent(
    totals: DataFrame, total: int, budget: int, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS
) -> float:
    """The exponent in [0, 1]: 1 keeps the sources' own shares, 0 makes them equal.

    With ``target_entropy`` (a share of the largest entropy, 0 to 1) the exponent at which
    the mixture's entropy is nearest to it; with ``max_repeats`` the smallest at which no
    source is read more often than that; with both the larger of the two, so the limit
    holds.  Both quantities fall as the exponent rises, so each interval that holds the
    crossing is cut in ``POINTS`` parts again and again.
    """

    def crossing(holds) -> float:
        lo, hi = 0.0, 1.0
        if holds(_at(totals, total, [lo])[0]):
            return lo
        for _ in range(8):
            points = [lo + (hi - lo) * k / POINTS for k in range(1, POINTS)]
            ok = [holds(x) for x in _at(totals, total, points)]
            first = ok.index(True) if True in ok else len(points)
            lo, hi = points[first - 1] if first else lo, points[first] if first < len(points) else hi
        return hi

    found = 1.0 if target_entropy is None and max_repeats is None else 0.0
    if target_entropy is not None:
        n = totals.filter("source_tokens > 0").count()
        found = max(found, crossing(lambda x: x[0] <= target_entropy * log(max(n, 1)) + 1e-12))
    if max_repeats is not None:
        found = max(found, crossing(lambda x: x[1] * budget <= max_repeats + 1e-12))
    return round(found, 6)


def mix_lengths(
    rows: DataFrame,
    budget_tokens: int | None = None,
    target_entropy: float | None = None,
    max_repeats: float | None = MAX_REPEATS,
    block_tokens: int = BLOCK_TOKENS,
    bucket_docs: int = BUCKET_DOCS,
    seed: int = 1,
    apart: str | None = None,
) -> DataFrame:
    """The schedule for rows of doc_id, source, n_tokens: one row for each time a document is read.

    doc_id, source, epoch (pass over the source), n_tokens, weight (the source's part of the
    mixture), block (from 0), slot (place in the block, from 1).  The budget is the sum of
    all tokens unless given, and is lowered to ``max_repeats`` times that sum if larger.
    A source's documents are taken while the tokens before them are within its part of
    the budget.  A null source is a source of its own; rows of no tokens take no budget.
    Ties between equal draws go by doc_id, then n_tokens.  An empty table gives an empty result.

    Rows without an id, and those equal to another one, have a number among their like in
    their draw, so neither is one bucket, and the schedule is the same on any
    partitioning.  With ``apart`` (a string column, handed on) rows are told apart by it too.
    """
    more = [apart] if apart else []
    rows = rows.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"), "n_tokens", *more)
    like = ["doc_id", "source", "n_tokens", *more]
    n_rows, n_apart = rows.agg(F.count(F.lit(1)), F.count_distinct(F.struct(*like))).first()
    rows = rows.withColumn("copy", F.lit(0).cast("long")) if n_rows == n_apart else materialise(numbered_copies(rows), "mix-copies")
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    told = [F.col("n_tokens"), *map(F.col, more), F.col("copy")]
    own = F.when(F.col("doc_id").isNull() | (F.col("copy") > 0) | F.lit(bool(apart)), F.concat_ws("|", own, *(c.cast("string") for c in told))).otherwise(own)
    ties = ["doc_id", "n_tokens", *more, "copy"]
    totals = materialise(source_totals(rows), "sources")
    n_sources, total = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_tokens"), F.lit(0))).first()
    budget = total if budget_tokens is None else budget_tokens
    budget = int(min(budget, max_repeats * total)) if max_repeats is not None else budget
    exponent = find_exponent(totals, total, budget, target_entropy, max_repeats) if total else 1.0
    power = F.pow(F.col("source_tokens") / F.lit(float(max(total, 1))), F.lit(exponent))
    norm = totals.filter("source_tokens > 0").agg(F.sum(power)).first()[0] or 1.0
    plan = totals.filter("source_tokens > 0").withColumn("weight", power / F.lit(norm))
    part = F.col("weight") * F.lit(float(budget))
    plan = plan.select(
        "source",
        "source_tokens",
        F.round("weight", 9).alias("weight"),
        F.floor(part).alias("part"),
        F.ceil(F.floor(part) / F.col("source_tokens")).cast("int").alias("epochs"),
        F.ceil(F.col("source_docs") / F.greatest(F.lit(float(bucket_docs)), F.sqrt("source_docs"))).cast("long").alias("n_buckets"),
    ).filter("epochs > 0")
    plan = F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan
    passes = (
        rows.join(plan, "source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
        .withColumn("u", draw(F.lit(seed), F.col("epoch"), own))
        .withColumn("bucket", F.shiftright(F.col("u") * F.col("n_buckets"), 32))
    )
    keys = ["source", "epoch", "bucket"]
    inside = Window.partitionBy(*keys).orderBy("u", *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = passes.withColumn("before_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    above = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        passes.groupBy(*keys)
        .agg(F.sum("n_tokens").alias("bucket_tokens"))
        .select(*keys, F.coalesce(F.sum("bucket_tokens").over(above), F.lit(0)).alias("bucket_start"))
    )
    placed = summed.join(offsets, keys).withColumn("start", F.col("epoch") * F.col("source_tokens") + F.col("bucket_start") + F.col("before_in"))
    n_blocks = max(1, ceil(budget / block_tokens))  # times a place in tokens: beyond a long at some 1e12 tokens
    taken = placed.filter("start < part").withColumn("block", F.expr(f"cast(start as decimal(20, 0)) * cast({n_blocks} as decimal(18, 0)) div cast(part as decimal(20, 0))"))
    order = Window.partitionBy("block").orderBy(draw(F.lit(seed), F.lit("slot"), F.col("epoch"), own), "doc_id", "epoch", "source", *ties[1:])
    return taken.select("doc_id", "source", F.col("epoch").cast("long").alias("epoch"), "n_tokens", "weight", "block", F.row_number().over(order).cast("long").alias("slot"), *more)


def lengths(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, n_tokens (words and an end) of whole texts, written once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_tokens(F.col(text_col)).alias("n_tokens"))
    return materialise(rows, "mix-lengths")


def mix(docs: DataFrame, **more) -> DataFrame:
    """The schedule over ``docs`` (doc_id, source, text); see ``mix_lengths``.

    A null text has one token, its end.  Rows repeated with one doc_id count each.  Other
    columns are not looked at.
    """
    return mix_lengths(lengths(docs), **more)


def take(docs: DataFrame, **more) -> DataFrame:
    """The rows of ``docs`` as often as the schedule reads them, with their columns as they were.

    Where ids are repeated or missing, rows are told apart by all their columns, and rows
    equal in all are read as often as the schedule reads any of them.  Null and empty
    texts and null sources are rows like any other; an empty table gives an empty result;
    extra columns come out as they were, whatever their names and types.
    """
    found = lengths(docs)
    n, n_ids, n_null = found.agg(F.count(F.lit(1)), F.count_distinct("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    if n == n_ids + n_null and n_null <= 1:
        schedule = materialise(mix_lengths(found, **more).select(F.col("doc_id").alias("_mix_id"), F.col("epoch").alias("_mix_epoch")), "mix")
        joined = docs.join(schedule, docs["doc_id"].eqNullSafe(schedule["_mix_id"]))
        return joined.select([docs[c] for c in docs.columns])
    digest, times, part, row = free_names(docs, "mix_digest", "mix_times", "mix_part", "mix_row")
    keyed = docs.withColumn(digest, row_digest(docs))
    own = keyed.select("doc_id", "source", word_tokens(F.col("text")).alias("n_tokens"), F.col(digest).alias("apart"))
    read = mix_lengths(materialise(own, "mix-apart"), **more, apart="apart").groupBy(F.col("apart").alias("_mix_digest")).agg(F.count(F.lit(1)).alias("_mix_times"))
    # One row for those that are equal, then as many as are read, written out in parts that are dealt anew.
    unique = keyed.groupBy(digest).agg(F.any_value(F.struct(*docs.columns)).alias(row)).join(materialise(read, "mix"), F.col(digest) == F.col("_mix_digest"))
    parts = unique.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_mix_times") - 1) / COPIES).cast("long")))).repartition(digest, part)
    left = F.least(F.lit(COPIES).cast("long"), F.col("_mix_times") - F.col(part) * COPIES)
    return parts.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), left))).select(f"{row}.*")


def entropy_of(weights: list[float]) -> float:
    """Entropy of normalised weights, in nats."""
    return -sum(w * log(w) for w in weights if w > 0)


def perplexity_of(weights: list[float]) -> float:
    """Effective number of sources."""
    return exp(entropy_of(weights))
