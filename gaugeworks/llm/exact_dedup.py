"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after deleting white space
(``[\\x20\\x09-\\x0D]``).  One pass over the texts writes a narrow table of
digests.  Misra-Gries summaries of its partitions name the digests that may be
frequent; those are counted exactly, and their winners (``capacity`` rows at
most, verified by length and a second hash) are broadcast, so that rows of
frequent digests are resolved on the map side.  All other digests take an
ordinary shuffle, in which no group can be larger than ``2 n / (capacity + 1)``
rows; these too are reduced before they are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .tables import free_names, row_digest

WHITE_SPACE = r"[\x20\x09-\x0D]"
CAPACITY = 1024


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_points (code points of the original), digest, octets and a second hash of the squeezed text."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
        squeezed(F.col(text_col)).alias("squeezed"),
    )
    return rows.select("doc_id", "n_points", F.sha2("squeezed", 256).alias("digest"), F.struct(F.octet_length("squeezed"), F.xxhash64("squeezed")).alias("verified"))


def summarise(counts: pd.Series, capacity: int) -> pd.Series:
    """Misra-Gries reduction: at most ``capacity`` counters stay, each short by the same amount at most."""
    if len(counts) > capacity:
        counts = counts - counts.nlargest(capacity + 1).iloc[-1]
        counts = counts[counts > 0]
    return counts


def frequent(keys: DataFrame, key_col: str, capacity: int = CAPACITY) -> DataFrame:
    """key, n for every key with more than ``2 rows / (capacity + 1)`` rows; ``capacity`` keys at most.

    Counters of all summaries add up to no more than the rows, so no more than
    ``capacity`` keys can exceed ``rows / (capacity + 1)``; a key above twice that
    keeps at least so much after all reductions.  Counts are exact.
    """
    n_rows = keys.count()

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.Series(dtype="int64")
        for batch in batches:
            kept = summarise(kept.add(batch["k"].value_counts(), fill_value=0).astype("int64"), capacity)
        yield pd.DataFrame({"k": kept.index.astype(object), "c": kept.to_numpy()})

    named = (
        keys.select(F.col(key_col).alias("k"))
        .mapInPandas(summaries, "k string, c long")
        .groupBy("k")
        .agg(F.sum("c").alias("c"))
        .filter(F.col("c") * F.lit(capacity + 1) > F.lit(n_rows))
        .select("k")
    )
    return (
        keys.select(F.col(key_col).alias("k"))
        .join(F.broadcast(named), "k")
        .groupBy("k")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") * F.lit(capacity + 1) > F.lit(2 * n_rows))
    )


def resolve(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, digest -> keep_id, group_size, kept for a table made by ``digests``."""
    hot = frequent(found, "digest", capacity).select(F.col("k").alias("digest"))
    better = F.struct("n_points", (-F.col("doc_id")).alias("minus_id"))
    winners = materialise(
        found.join(F.broadcast(hot), "digest")
        .groupBy("digest")
        .agg(F.max(better).alias("best"), F.count(F.lit(1)).alias("group_size"), F.min("verified").alias("lo"), F.max("verified").alias("hi"))
        .filter("lo = hi")
        .select("digest", (-F.col("best.minus_id")).alias("keep_id"), "group_size"),
        "winners",
    )
    on_map_side = found.join(F.broadcast(winners), "digest", "left")
    others = on_map_side.filter("group_size is null").select("doc_id", "n_points", "digest")
    groups = others.groupBy("digest").agg(F.max(better).alias("best"), F.count(F.lit(1)).alias("group_size"))
    rest = others.join(groups, "digest").select("doc_id", (-F.col("best.minus_id")).alias("keep_id"), "group_size", "digest")
    both = on_map_side.filter("group_size is not null").select("doc_id", "keep_id", "group_size", "digest").unionByName(rest)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the smallest
    doc_id; a null doc_id comes after every other.  A null text counts as empty,
    and all empty texts are one group.  Rows repeated with the same doc_id count
    in ``group_size`` and carry the same ``kept``; ``drop_copies`` leaves one.
    An empty table gives an empty result.  Other columns are not looked at.  Ids are
    numbers (of two the smaller one stays).
    """
    return resolve(materialise(digests(docs, id_col, text_col), "digests"), capacity)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they were.

    Decisions are joined back by (doc_id, digest).  If the same doc_id is repeated
    with an equal text, the longest of those rows stays, then the one of the least digest
    of all columns.  Null and empty texts are one group; a
    row without doc_id stays only where no row of its group has one; very long texts are
    compared whole; an empty table stays empty; extra columns may have any names.
    """
    found = materialise(digests(docs, id_col, text_col), "digests")
    kept = materialise(resolve(found, capacity).filter("kept").select(F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_digest")), "kept")
    n_kept, unique = kept.count(), kept.distinct()
    digest, rank = free_names(docs, "row_digest", "row_rank")
    keyed = docs.withColumn(digest, F.sha2(squeezed(F.col(text_col)), 256))
    out = keyed.join(unique, keyed[id_col].eqNullSafe(unique["_keep_id"]) & (keyed[digest] == unique["_keep_digest"]), "left_semi")
    if unique.count() < n_kept:
        # One of the rows that share id and text, by partial results: no id is one task.
        better = F.struct((-F.length(F.col(text_col))).alias("n"), row_digest(docs).alias("d"))
        out = out.groupBy(id_col, digest).agg(F.min_by(F.struct(*docs.columns), better).alias(rank)).select(f"{rank}.*")
    return out.select(*docs.columns)
