"""Conflict-constrained best-fit packing of documents into fixed-length sequences.

Documents (as narrow rows, without their texts) are dealt by hash into shards of
about ``shard_docs`` documents; each shard is packed by itself, longest piece first.
The open bins of a shard are kept in order of their free space, each with bitmaps of
the sources and duplicate clusters in it.  The search starts at the first bin with
room enough and goes on to its successors until a bin is found that carries neither
the piece's cluster nor its source too often: the tightest compatible bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoding import encoded_lengths
from .storage import materialise

CAPACITY = 2048
#: Documents of one source that a sequence may hold; of one duplicate cluster it holds one.
SOURCE_LIMIT = 4
SHARD_DOCS = 4096


def bit_numbers(keys: list) -> list[int]:
    """A bit for every key that occurs twice or more; 0 for the rest, which can't conflict."""
    counts: dict = {}
    for k in keys:
        counts[k] = counts.get(k, 0) + 1
    numbers: dict = {}
    for k, n in counts.items():
        if n > 1:
            numbers[k] = 1 << len(numbers)
    return [numbers.get(k, 0) for k in keys]


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int, source_limit: int) -> tuple[list[int], list[int]]:
    """Bin number and offset in it for pieces of at most ``capacity``, packed in the order given.

    A source's bit stands in plane k of a bin's bitmaps once k + 1 of its documents are in
    the bin; the last plane says that the source may not come again.
    """
    source_bits, cluster_bits = bit_numbers(sources), bit_numbers(clusters)
    open_bins: list[tuple[int, int]] = []  # (free space, bin), ascending
    planes: list[list[int]] = []
    in_bin: list[int] = []
    bins, offsets = [], []
    for need, source, cluster in zip(lengths, source_bits, cluster_bits, strict=True):
        at = bisect_left(open_bins, (need, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (in_bin[b] & cluster or planes[b][-1] & source):
                break
            at += 1
        if at < len(open_bins):
            free, b = open_bins.pop(at)
        else:
            free, b = capacity, len(planes)
            planes.append([0] * source_limit)
            in_bin.append(0)
        bins.append(b)
        offsets.append(capacity - free)
        in_bin[b] |= cluster
        for k, plane in enumerate(planes[b]):
            if not plane & source:
                planes[b][k] = plane | source
                break
        if free > need:
            insort(open_bins, (free - need, b))
    return bins, offsets


PACKED = "shard long, bin long, offset long, doc_id {id}, source string, cluster long, piece long, piece_start long, n_tokens long"
#: Copies of one row that a task writes out at most.
COPIES = 4096


def numbered_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with column ``copy``: 0, 1, 2, ... for rows equal in all columns.

    Equal rows are counted by partial sums and written out again from their number, in
    parts that are dealt anew, so that a row repeated very often is never one task.
    """
    keys = rows.columns
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_copies") - 1) / COPIES).cast("long"))))
    parts = parts.repartition(*keys, "part")
    first = F.col("part") * COPIES
    return parts.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("n_copies")) - 1))).select(*keys, "copy")


def pack_lengths(rows: DataFrame, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Packs rows of doc_id, source, cluster (long), n_tokens: one row per piece.

    bin_id (shard and bin, as one long), offset in the bin, doc_id, source, cluster, piece (from 0),
    piece_start, n_tokens of the piece.  A document longer than ``capacity`` is cut: each
    full piece fills a sequence of its own, the rest is packed like any other document.
    Documents without tokens come out as one piece of length 0 (they never need a bin of
    their own unless every bin conflicts).  Null sources and clusters never conflict.
    """
    keys = ["doc_id", "source", "cluster", "n_tokens"]
    rows = rows.select(*keys)
    n_rows, n_ids = rows.agg(F.count(F.lit(1)), F.count_distinct(F.struct(*keys))).first()
    n_shards = max(1, ceil(n_rows / shard_docs))
    # Rows equal in all these have a number each, or they would be one shard.
    rows = rows.withColumn("copy", F.lit(0).cast("long")) if n_ids == n_rows else numbered_copies(rows)
    sharded = rows.select(*keys, F.pmod(F.xxhash64("doc_id", "cluster", "n_tokens", F.lit(7), "copy"), F.lit(n_shards)).alias("shard"))

    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "cluster"], ascending=[False, True, True], kind="stable")
        full, left = pdf["n_tokens"] // capacity, pdf["n_tokens"] % capacity
        whole = pdf.loc[pdf.index.repeat(full)]
        whole = whole.assign(piece=whole.groupby(level=0).cumcount(), n_tokens=capacity, offset=0, bin=range(len(whole)))
        rest = pdf.assign(piece=full, n_tokens=left)[(left > 0) | (full == 0)].sort_values("n_tokens", ascending=False, kind="stable")
        alone = iter(range(-1, -len(rest) * 2 - 2, -1))  # stands for null: equal to nothing else
        sources = [s if isinstance(s, str) else next(alone) for s in rest["source"]]
        clusters = [(0, c) if not pd.isna(c) else next(alone) for c in rest["cluster"]]
        bins, offsets = best_fit(rest["n_tokens"].astype(int).tolist(), sources, clusters, capacity, source_limit)
        rest = rest.assign(bin=[len(whole) + b for b in bins], offset=offsets)
        both = pd.concat([whole, rest])
        both["piece_start"] = both["piece"] * capacity
        return both[["shard", "bin", "offset", "doc_id", "source", "cluster", "piece", "piece_start", "n_tokens"]]

    packed = sharded.groupBy("shard").applyInPandas(of, PACKED.format(id=rows.schema["doc_id"].dataType.simpleString()))
    return packed.select(
        F.shiftleft("shard", 24).bitwiseOR(F.col("bin")).alias("bin_id"), "offset", "doc_id", "source", "cluster", "piece", "piece_start", "n_tokens"
    )


def text_cluster(text: Column) -> Column:
    """Cluster of exact copies: a hash of the whole text (a chance collision only keeps two apart)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster: Column | None = None,
    capacity: int = CAPACITY,
    source_limit: int = SOURCE_LIMIT,
    shard_docs: int = SHARD_DOCS,
    tokenizer: str | None = None,
) -> DataFrame:
    """Packs whole texts by their encoded lengths; see ``pack_lengths`` for the rows.

    ``cluster`` says which documents are copies of each other (default: equal texts).  Ids
    are of any type, null ones too.  A null text counts as empty; repeated rows are packed as often as they come, in bins of
    their own each; an empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        (text_cluster(F.col(text_col)) if cluster is None else cluster.cast("long")).alias("cluster"),
        F.col(text_col).alias("text"),
    )
    return pack_lengths(materialise(encoded_lengths(rows, "text", tokenizer), "packing"), capacity, source_limit, shard_docs)
