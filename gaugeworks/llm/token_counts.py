"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by encoded length once.  Suffix sums over the histogram
then answer, for every context limit: how many documents and tokens lie at or
above it, what is left when each document is cut there, and which quantile it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoded_lengths
from .storage import materialise

#: Lengths per bucket of the two-level sums: no window reads more than this many rows of
#: the histogram, and the upper one reads one row for each bucket.
BUCKET = 1024


def length_histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """n_tokens, n_docs: documents by encoded length; texts without ids have length 0."""
    return encoded_lengths(docs.select(text_col), text_col, path).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per length L that occurs, as a context limit.

    context_limit = L; n_docs of that length; docs_at_least, tokens_at_least: documents
    of L or more tokens and their tokens; docs_up_to, quantile: documents of at most L
    tokens, and their share; total_tokens: of all documents; truncated_tokens: the sum
    of min(length, L); cut_tokens: the rest.  Sums are exact integers.
    """
    sized = histogram.withColumn("bucket", F.floor(F.col("n_tokens") / F.lit(bucket))).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    upper = sized.groupBy("bucket").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = upper.select(
        "bucket",
        F.coalesce(F.sum("b_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("b_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("b_docs").over(every).alias("all_docs"),
        F.sum("b_tokens").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = sized.select(
        "bucket", "n_tokens", "n_docs", "tokens", F.sum("n_docs").over(inside).alias("docs_in"), F.sum("tokens").over(inside).alias("tokens_in")
    ).join(offsets, "bucket")
    at_least = F.col("docs_in") + F.col("docs_above")
    tokens_at_least = F.col("tokens_in") + F.col("tokens_above")
    up_to = F.col("all_docs") - at_least + F.col("n_docs")
    truncated = F.col("all_tokens") - tokens_at_least + F.col("n_tokens") * at_least
    return summed.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        up_to.alias("docs_up_to"),
        (up_to / F.col("all_docs")).alias("quantile"),
        F.col("all_tokens").alias("total_tokens"),
        truncated.alias("truncated_tokens"),
        (F.col("all_tokens") - truncated).alias("cut_tokens"),
    )


def token_counts(docs: DataFrame, text_col: str = "text", path: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """Suffix sums over the lengths of all documents, whole texts.

    Null and blank texts count as documents of length 0; repeated rows count as often
    as they come; an empty table gives an empty result; other columns are not looked at.
    """
    return suffix_sums(materialise(length_histogram(docs, text_col, path), "lengths"), bucket)


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """truncated_tokens and docs_cut for any context limits, also lengths that do not occur."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "asked long")
    longer = sums.join(F.broadcast(asked), sums["context_limit"] > asked["asked"], "right")
    return longer.groupBy("asked").agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs_cut"),
        F.coalesce(F.sum(F.col("n_docs") * (F.col("context_limit") - F.col("asked"))), F.lit(0)).alias("cut_tokens"),
    )
