"""Hashes that differ in a few bits: an index of blocks, asked with flipped bits.

If two hashes differ in at most k bits, one of b blocks differs in at most k / b of its
bits.  The indexed side has one row for each block of each distinct hash; the asking side
has one for each block and each way to flip so few of its bits.  These are joined on
(block, value), and every candidate's distance is counted, so the result is exact.  Few
wide blocks mean many flips and few candidates, many narrow ones the opposite: b is the
one with the least work for the number of hashes.

Where many bits may differ (14 of 56), no cut into blocks leaves few candidates, and the
close pairs themselves grow with the square of the hashes.  ``near_totals`` then counts the
bits of all pairs, tile by tile, and gives one row a hash.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.resampling import written

WIDTH = 64
#: Hashes of each side that one task compares, at most (on average) and, before there are tiles for all cores, at least; how many of both at once.
TILE, LEAST_TILE, AT_ONCE = 65_536, 512, (64, 4096)
NO_KEY = (1 << 63) - 1
#: Flips of a block that are asked for at most.
MOST_FLIPS = 1_000


def blocks_for(n: int, bits: int, width: int = WIDTH) -> int:
    """How many blocks to cut a hash into, if n distinct ones are indexed and up to ``bits`` may differ."""

    def work(b: int) -> float:
        narrow, radius = width // b, bits // b
        flips = sum(comb(-(-width // b), r) for r in range(radius + 1))
        return b * flips * (1 + n / 2.0**narrow) if flips <= MOST_FLIPS else float("inf")

    best = min(range(1, width + 1), key=work)
    if work(best) == float("inf"):
        raise ValueError(f"{bits} bits of {width} are too many")
    return best


def edges_of(b: int, width: int) -> list[int]:
    return [width * i // b for i in range(b + 1)]


def masks(size: int, radius: int) -> list[int]:
    """All ways to flip up to ``radius`` of ``size`` bits."""
    return [sum(1 << i for i in chosen) for r in range(min(radius, size) + 1) for chosen in combinations(range(size), r)]


def block(h: Column, start: int, end: int) -> Column:
    mask = (1 << end - start) - 1
    return F.shiftrightunsigned(h, start).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1).cast("long"))


def near_hashes(left: DataFrame, right: DataFrame, bits: int, width: int = WIDTH, b: int | None = None) -> DataFrame:
    """h1, h2, distance: the distinct hashes (column ``h``, long) of both sides that differ in at most ``bits`` of the lowest ``width`` bits."""
    if not 0 <= bits <= width:
        raise ValueError(f"between 0 and {width} bits")
    asking, indexed = left.select(F.col("h").alias("h1")).filter("h1 is not null").distinct(), right.select(F.col("h").alias("h2")).filter("h2 is not null").distinct()
    b = b or blocks_for(indexed.count(), bits, width)
    edges = edges_of(b, width)
    spans = list(zip(edges, edges[1:], strict=False))
    keyed = indexed.select("h2", F.inline(F.array(*(F.struct(F.lit(i).alias("part"), block(F.col("h2"), lo, hi).alias("value")) for i, (lo, hi) in enumerate(spans)))))
    asked = None
    for i, (lo, hi) in enumerate(spans):
        flips = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks(hi - lo, bits // b)))
        value = block(F.col("h1"), lo, hi)
        one = asking.select("h1", F.lit(i).alias("part"), value.alias("value"), F.explode(flips).alias("mask")).select("h1", "part", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        asked = one if asked is None else asked.unionByName(one)
    distance = F.bit_count(F.col("h1").bitwiseXOR(F.col("h2")))
    return asked.join(keyed, ["part", "value"]).filter(distance <= bits).select("h1", "h2", distance.alias("distance")).distinct()


def compared(asked: np.ndarray, held: np.ndarray, n: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each hash asked for: the sum of ``n``, the least of ``first`` and the least distance over the hashes held within ``bits`` bits of it."""
    asked, held = asked.view(np.uint64), held.view(np.uint64)
    total, least, nearest = np.zeros(len(asked), np.int64), np.full(len(asked), NO_KEY), np.full(len(asked), WIDTH + 1)
    rows, columns = AT_ONCE
    for c in range(0, len(held), columns):
        part = held[c : c + columns]
        for r in range(0, len(asked), rows):
            distance = np.bitwise_count(asked[r : r + rows, None] ^ part).ravel()
            hits = np.flatnonzero(distance <= bits)
            i, j = hits // len(part) + r, hits % len(part) + c
            np.add.at(total, i, n[j])
            np.minimum.at(least, i, first[j])
            np.minimum.at(nearest, i, distance[hits])
    return total, least, nearest


def near_totals(left: DataFrame, right: DataFrame, bits: int, key: str | None = None, tile: int = TILE) -> DataFrame:
    """h1, n_close, least, nearest: for each distinct hash (column ``h``, long) of ``left`` that has rows of ``right`` within ``bits`` bits, their number, their least ``key`` (long) and the least distance.

    All distinct hashes of one side are compared with all of the other: both are dealt into
    chunks, and each pair of chunks is a task of its own, which gives one row a hash.  So
    memory is bounded, while the comparisons (about two nanoseconds each) are quadratic.
    """
    if not 0 <= bits <= WIDTH:
        raise ValueError(f"between 0 and {WIDTH} bits")
    cores = left.sparkSession.sparkContext.defaultParallelism
    of_key = F.min(key) if key else F.lit(None).cast("long")
    asking = written(left.select("h").filter("h is not null").distinct(), "asking")
    whole = written(right.filter("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.coalesce(of_key, F.lit(NO_KEY)).alias("first")), "whole")

    def chunks(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
        n = rows.count()
        dealt = max(1, ceil(n / tile), min(ceil(sqrt(4 * cores)), ceil(n / LEAST_TILE)))
        packed = rows.groupBy(F.pmod(F.xxhash64("h"), F.lit(dealt)).alias(name)).agg(F.collect_list(F.struct(*columns)).alias("_rows"))
        return packed.select(name, *(F.col(f"_rows.{c}").alias(f"{name}_{c}") for c in columns))

    tiles = chunks(asking, "a", ["h"]).crossJoin(chunks(whole, "b", ["h", "n", "first"])).repartition(4 * cores, "a", "b")

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["a_h"].iloc[0]
        total, least, nearest = compared(asked, pdf["b_h"].iloc[0], pdf["b_n"].iloc[0], pdf["b_first"].iloc[0], bits)
        return pd.DataFrame({"h1": asked, "n_close": total, "least": least, "nearest": nearest})[total > 0]

    each = tiles.groupBy("a", "b").applyInPandas(totals, "h1 long, n_close long, least long, nearest int")
    done = each.groupBy("h1").agg(F.sum("n_close").alias("n_close"), F.min("least").alias("least"), F.min("nearest").alias("nearest"))
    return done.withColumn("least", F.nullif("least", F.lit(NO_KEY)))


def difference_hash(grid: Column, columns: int, rows: int) -> Column:
    """A bit for each pair of neighbours in a row of the grid: whether the right one is greater.  The first pair is the highest bit.

    ``grid``: an array of ``columns * rows`` numbers, row by row.  A null or shorter array gives NULL.
    """
    at = [r * columns + c for r in range(rows) for c in range(columns - 1)]
    if len(at) > 64:
        raise ValueError(f"{len(at)} pairs don't fit into 64 bits")
    bits = F.lit(0).cast("long")
    for k, i in enumerate(at):
        bits = bits.bitwiseOR(F.shiftleft((grid[i] < grid[i + 1]).cast("long"), len(at) - 1 - k))
    return F.when(F.size(grid) >= columns * rows, bits)


def overlap(ours: DataFrame, theirs: DataFrame, held: str, bits: int) -> DataFrame:
    """One row: n_ours, n_theirs (distinct hashes), hits_train, hits_val (rows of ``ours`` near one of theirs), nearest, abort.

    ``held``: whether a row of ours is held out.  A hit among the held-out ones aborts, as
    what is trained on theirs would have seen them; one among the others does not.
    """
    near = near_totals(ours, theirs, bits).select("h1", F.col("nearest").alias("distance"))
    met = ours.select("h", held).join(near, F.col("h") == F.col("h1"), "left")
    sizes = theirs.agg(F.count_distinct("h").alias("n_theirs"))
    hit = F.col("distance").isNotNull()
    told = met.agg(
        F.count_distinct("h").alias("n_ours"), F.count_if(hit & ~F.col(held)).alias("hits_train"), F.count_if(hit & F.col(held)).alias("hits_val"), F.min("distance").alias("nearest")
    )
    return told.crossJoin(sizes).select("n_ours", "n_theirs", "hits_train", "hits_val", "nearest", (F.col("hits_val") > 0).alias("abort"))
