"""Bootstrap counts by a tree of binomial splits: no row for a draw.

A replicate draws n of n clusters with replacement.  How many of the draws fall to one
half of the clusters is a binomial number, and so on within each half, down to leaves of
some clusters, where a multinomial says how often each is drawn.  Every split comes from
a generator seeded by its place in the tree, so each task finds the counts of its own
leaf by walking down to it, and all tasks agree without telling each other anything.
What is shuffled are the clusters, once, and a sum for each replicate and task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.sources import folders

#: Clusters whose counts are drawn at once, and parts that a cell's clusters are dealt into at most.
LEAF, MOST_BUCKETS = 256, 4096
#: Distinct values of a cluster that the two-level bootstrap takes at most.
MAX_VALUES = 1024


def generator(seed: int, cell: int, *place: int) -> np.random.Generator:
    return np.random.default_rng([seed, cell % (1 << 64), *place])


def counts_of(seed: int, cell: int, starts: Sequence[int], bucket: int, draws: int) -> np.ndarray:
    """For each replicate, how many of the cell's draws fall to one bucket; ``starts``: clusters before each bucket, and all of them."""
    lo, hi = 0, len(starts) - 1
    counts = np.full(draws, starts[-1], np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        whole = starts[hi] - starts[lo]
        left = generator(seed, cell, 0, lo, hi).binomial(counts, (starts[mid] - starts[lo]) / whole) if whole else np.zeros_like(counts)
        if bucket < mid:
            hi, counts = mid, left
        else:
            lo, counts = mid, counts - left
    return counts


def leaves(seed: int, cell: int, bucket: int, lo: int, hi: int, counts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, counts) of the leaves of a bucket's clusters."""
    if hi - lo <= LEAF:
        yield lo, hi, counts
        return
    mid = (lo + hi) // 2
    left = generator(seed, cell, 1, bucket, lo, hi).binomial(counts, (mid - lo) / (hi - lo))
    yield from leaves(seed, cell, bucket, lo, mid, left)
    yield from leaves(seed, cell, bucket, mid, hi, counts - left)


def bucket_sums(seed: int, cell: int, starts: Sequence[int], bucket: int, values: list, sizes: list, draws: int, inner: bool) -> np.ndarray:
    """For each replicate the sum over its draws from a bucket of the clusters' means; with ``inner`` of means resampled within the cluster.

    ``values``, ``sizes``: distinct values of each cluster, and how many rows have them.  A
    cluster drawn m times is resampled m times; together these are one multinomial of m
    times its rows.
    """
    total = np.zeros(draws)
    held = [(np.asarray(v, float), np.asarray(n, np.int64)) for v, n in zip(values, sizes, strict=True)]
    for lo, hi, counts in leaves(seed, cell, bucket, 0, len(held), counts_of(seed, cell, starts, bucket, draws)):
        times = generator(seed, cell, 2, bucket, lo).multinomial(counts, np.full(hi - lo, 1 / (hi - lo)))
        if not inner:
            total += times @ np.array([(v * n).sum() / n.sum() for v, n in held[lo:hi]])
            continue
        for k in range(lo, hi):
            v, n = held[k]
            rows = int(n.sum())
            picked = generator(seed, cell, 3, bucket, k).multinomial(times[:, k - lo] * rows, n / rows)
            total += picked @ v / rows
    return total


def written(df: DataFrame, label: str) -> DataFrame:
    path = folders.fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tree_bootstrap(
    rows: DataFrame, by: Sequence[str], cluster: str, value: Column, draws: int = 2000, seed: int = 0, level: float = 0.95, inner: bool = False, most_buckets: int = MOST_BUCKETS
) -> DataFrame:
    """by, n, n_clusters, point (mean of cluster means), ci_low, ci_high from ``draws`` resamples of the clusters.

    With ``inner``, rows are resampled within the drawn clusters too.  Rows enter as counts
    of their cluster's distinct values (more than ``MAX_VALUES`` of them raise); NULL values
    are left out, and clusters without any other; an empty table gives an empty result.
    The same on any partitioning and after any retry.
    """
    keys = [F.col(c) for c in by]
    cells = rows.select(*by, F.col(cluster).alias("_cluster"), value.cast("double").alias("v")).filter("v is not null").groupBy(*by, "_cluster", "v").agg(F.count(F.lit(1)).alias("n"))
    if not inner:  # only a cluster's mean matters
        cells = cells.groupBy(*by, "_cluster").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"), F.sum("n").alias("n"))
    hashed = F.xxhash64(F.concat_ws("|", F.lit("boot"), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys)))
    cells = written(cells.withColumn("_cell", hashed), "clusters")
    most = cells.groupBy(*by, "_cluster").count().agg(F.max("count")).first()[0]
    if most and most > MAX_VALUES:
        raise ValueError(f"a cluster has {most} distinct values, at most {MAX_VALUES} are resampled by counts")
    values = cells.groupBy(*by, "_cell", "_cluster").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("_held"), F.sum("n").alias("n"))
    sizes = values.groupBy("_cell").agg(F.count(F.lit(1)).alias("_clusters"))
    dealt = values.join(sizes, "_cell").withColumn("_buckets", F.least(F.lit(most_buckets), F.ceil(F.col("_clusters") / LEAF)).cast("int"))
    dealt = dealt.withColumn("_bucket", F.pmod(F.xxhash64("_cluster", F.lit(7)), F.col("_buckets")).cast("int"))
    # A row for each bucket, ``most_buckets`` of a cell at most: where each begins.
    counted = dealt.groupBy("_cell", "_buckets", "_bucket").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.partitionBy("_cell").orderBy("_bucket"))
    upto = counted.withColumn("_upto", before).groupBy("_cell", "_buckets").agg(F.array_sort(F.collect_list(F.struct("_bucket", "_upto"))).alias("_ends"))

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, bucket = key
        pdf = pdf.sort_values("_cluster", kind="stable")
        starts = np.zeros(int(pdf["_buckets"].iloc[0]) + 1, np.int64)
        for end in pdf["_ends"].iloc[0]:
            starts[end["_bucket"] + 1] = end["_upto"]
        starts = np.maximum.accumulate(starts)  # a bucket without clusters ends where it begins
        held = [([x["v"] for x in h], [x["n"] for x in h]) for h in pdf["_held"]]
        found = bucket_sums(seed, int(cell), starts.tolist(), int(bucket), [v for v, _ in held], [n for _, n in held], draws, inner)
        return pd.DataFrame({"_cell": cell, "replicate": np.arange(draws, dtype=np.int32), "s": found})

    each = dealt.join(upto, ["_cell", "_buckets"]).select("_cell", "_bucket", "_buckets", "_cluster", "_held", "_ends").groupBy("_cell", "_bucket").applyInPandas(sums, "_cell long, replicate int, s double")
    replicates = each.groupBy("_cell", "replicate").agg(F.sum("s").alias("s")).join(sizes, "_cell").select("_cell", (F.col("s") / F.col("_clusters")).alias("m"))
    tail = (1 - level) / 2
    ci = replicates.groupBy("_cell").agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("ci"))
    mean = F.aggregate("_held", F.lit(0.0), lambda s, x: s + x["v"] * x["n"]) / F.col("n")
    point = values.groupBy(*by, "_cell").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_clusters"), F.avg(mean).alias("point"))
    return point.join(ci, "_cell").select(*by, "n", "n_clusters", "point", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"))
