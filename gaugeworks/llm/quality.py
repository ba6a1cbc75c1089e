"""Quality by importance resampling.

Two bags of hashed word unigrams and bigrams are counted: one over the good texts of
a labelled sample (target), one over the whole corpus (raw).  A document's importance
is the ratio of the two models' likelihoods, per n-gram and scaled to a reference
length, so that long texts aren't judged by their length, nor short ones by a few
words.  Gumbel noise on the log of the weight turns the k largest into a sample without
replacement (Gumbel top-k); k is given, or is the share of good ones among the labels,
somewhat raised, of all documents.  No score decides k, so it is the ranking that selects.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise
from .tables import free_names

BITS = 16
#: Labelled rows that the target model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Pseudo-counts that draw the ratio of a rare bucket to 1, as a share of the target's mean count.
SHRINK = 0.5
#: Length that weights are scaled to, and n-grams of ratio 1 that every text is taken to have besides its own.
REFERENCE_GRAMS = 200.0
NEUTRAL_GRAMS = 100
#: Part of the bad share that is kept on top of the good share: a good document lost is worse than a bad one passed.
SLACK = 0.05
CHUNK = 4096
#: Groups of tasks whose counts are summed before those of all.
FIRST_SUMS = 1024
#: Edges counted in one pass, and scores that come to the driver at most, when the k-th largest is sought.
EDGES, FEW_SCORES = 30, 5000
KNOWN_WORDS = 400_000

_known: dict[str, int] = {}


def gram_buckets(text: str | None, bits: int = BITS) -> np.ndarray:
    """Buckets of the hashed lower-cased words and neighbouring pairs of a whole text."""
    words = (text or "").lower().split()
    if len(_known) > KNOWN_WORDS:
        _known.clear()
    for w in set(words):
        if w not in _known:
            _known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    one = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    if len(one) > 1:
        two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
        one = np.concatenate((one, two ^ (two >> np.uint64(29))))
    return (one & np.uint64((1 << bits) - 1)).astype(np.int64)


def worst_labels(labels: DataFrame) -> DataFrame:
    """_label_id, quality, toxic: of several labels of an id the worst counts."""
    usable = labels.filter("doc_id is not null and quality is not null")
    return usable.groupBy(F.col("doc_id").alias("_label_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def labelled_sample(worst: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """_label_id, good (true) of at most ``rows`` documents of quality 1 that aren't toxic, by the hash of their id."""
    return worst.filter("quality = 1 and toxic = 0").select("_label_id", F.lit(True).alias("good")).orderBy(F.xxhash64("_label_id"), "_label_id").limit(rows)


def good_share(worst: DataFrame) -> float | None:
    """Share of labelled documents of quality 1; None where all are alike, or there are none."""
    n, n_good = worst.agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 1)).first()
    return n_good / n if 0 < n_good < n else None


def gram_counts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, bits: int = BITS) -> np.ndarray:
    """Counts of every bucket: row 0 over all documents (raw), row 1 over the sample's (target).

    Each task sums its documents and sends arrays in chunks.  These are summed in two
    steps, first those of some of the tasks and then all, so that no reducer reads the
    arrays of every task; what reaches the driver is ``2 x 2 ** bits`` counts.
    """
    size = 1 << bits
    step = min(CHUNK, size)
    marked = docs.select(F.col(id_col).alias("_label_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_label_id", "left")
    marked = marked.select("text", F.coalesce("good", F.lit(False)).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                buckets = gram_buckets(text.as_py(), bits)
                np.add.at(total[0], buckets, 1)
                if target:
                    np.add.at(total[1], buckets, 1)
        yield as_rows({k: total[:, k * step : (k + 1) * step] for k in range(size // step)})

    def as_rows(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.int64).reshape(2, -1)
        if sums:
            yield as_rows(sums)

    ddl = "chunk int, counts binary"
    counted = marked.mapInArrow(count, ddl)
    some = counted.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(FIRST_SUMS))).repartition("chunk", "some").select("chunk", "counts")
    summed = some.mapInArrow(add, ddl).repartition("chunk").mapInArrow(add, ddl).collect()
    total = np.zeros((2, size), np.int64)
    for row in summed:
        total[:, row["chunk"] * step : (row["chunk"] + 1) * step] += np.frombuffer(row["counts"], np.int64).reshape(2, -1)
    return total


def log_ratios(raw: np.ndarray, target: np.ndarray, shrink: float = SHRINK) -> np.ndarray:
    """Log of target model over raw model for each bucket, drawn to 0 where the target says little."""
    if not raw.sum() or not target.sum():
        return np.zeros(len(raw))
    more = max(shrink * target.mean(), 1.0)
    return np.log((target + more) / (raw * (target.sum() / raw.sum()) + more))


def scored(docs: DataFrame, ratios: np.ndarray, n_grams: str, log_weight: str, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with all its columns, its n-grams and log weight; a text without words weighs 1 (log 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_grams, T.LongType()), T.StructField(log_weight, T.DoubleType())])
    at = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column(at)):
                buckets = gram_buckets(text.as_py(), bits)
                if len(buckets):
                    n[k], weight[k] = len(buckets), REFERENCE_GRAMS * table[buckets].sum() / (len(buckets) + NEUTRAL_GRAMS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(weight)], names=schema.fieldNames())

    return docs.mapInArrow(of, schema)


def gumbel(id_col: str, seed: int) -> Column:
    """Standard Gumbel noise that depends on the seed and the id only."""
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double")
    return -F.log(-F.log((draw + F.lit(0.5)) / F.lit(4294967296.0)))


def ordinal(x: float) -> int:
    """The place of a double among all doubles; 0 for 0."""
    n = int(np.abs(np.float64(x)).view(np.int64))
    return n if x >= 0 else -n


def double_at(place: int) -> float:
    x = float(np.int64(abs(place)).view(np.float64))
    return x if place >= 0 else -x


def top_k_cut(scores: DataFrame, k: int, few: int = FEW_SCORES) -> float:
    """The k-th largest of column ``score``; inf for none, -inf for all.

    Found by counting: between a score that ``k`` or more reach and one that fewer reach,
    the scores at ``EDGES`` doubles evenly placed among all doubles are counted (by
    comparison with the very edges, so rounding moves no score), until few scores or no
    doubles lie between the two: in 13 passes at most.
    """
    span = scores.agg(F.min("score"), F.max("score"), F.count(F.lit(1))).first()
    if not span[2] or k <= 0:
        return float("inf")
    if k >= span[2]:
        return float("-inf")
    lo, hi, reach_lo, reach_hi = ordinal(span[0]), ordinal(span[1]) + 1, span[2], 0
    while reach_lo - reach_hi > few and hi - lo > 1:
        inner = sorted({lo + (hi - lo) * j // (EDGES + 1) for j in range(1, EDGES + 1)} - {lo})
        reach = list(scores.agg(*(F.count_if(F.col("score") >= F.lit(double_at(e))) for e in inner)).first())
        edges, counts = [lo, *inner, hi], [reach_lo, *reach, reach_hi]
        at = max(i for i, n in enumerate(counts) if n >= k)
        lo, hi, reach_lo, reach_hi = edges[at], edges[at + 1], counts[at], counts[at + 1]
    if hi - lo == 1:
        return double_at(lo)  # all that lie between are this very score
    inside = scores.filter((F.col("score") >= F.lit(double_at(lo))) & (F.col("score") < F.lit(double_at(hi)))).collect()  # few at most
    return sorted((r[0] for r in inside), reverse=True)[k - reach_hi - 1]


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int | None = None,
    seed: int = 6,
    bits: int = BITS,
    sample_rows: int = SAMPLE_ROWS,
    narrow: bool = False,
) -> DataFrame:
    """``docs`` with all its columns (``narrow``: without the text, and written) and _n_grams, _log_weight, _score, _kept.

    Gumbel top-k over all documents: ``_score`` is the log weight plus noise, and the k
    largest are kept (ties at the k-th all stay).  Without k, it is the good share of the
    labels, raised by ``SLACK`` of what is missing to 1, times the documents, rounded up.
    With no usable labels, or only one kind, every document is kept.
    Null and blank texts have no n-grams, a log weight of 0 and take part like any other.
    Repeated rows share their noise.  An empty table stays empty.  The four columns come
    under these names with more underscores where ``docs`` has them already.
    """
    worst = materialise(worst_labels(labels), "labels")
    sample = docs.sparkSession.createDataFrame(labelled_sample(worst, sample_rows).collect(), "_label_id long, good boolean")  # sample_rows at most
    ratios = log_ratios(*gram_counts(docs, sample, id_col, text_col, bits))
    n_grams, log_weight, score_col, kept = free_names(docs, "_n_grams", "_log_weight", "_score", "_kept")
    score = F.col(log_weight) + gumbel(id_col, seed)
    everything = scored(docs, ratios, n_grams, log_weight, text_col, bits).withColumn(score_col, score)
    if narrow:
        everything = materialise(everything.drop(text_col), "scored")
        scores = everything.select(F.col(score_col).alias("score"))
    else:
        scores = materialise(everything.select(F.col(score_col).alias("score")), "scores")
    if k is None:
        share, n = good_share(worst), scores.count()
        k = n if share is None else ceil(n * (share + SLACK * (1 - share)))
    return everything.withColumn(kept, F.col(score_col) >= F.lit(float(top_k_cut(scores, k))))


def decisions(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """doc_id, n_grams, log_weight, score, kept: one row per document."""
    found = resample(docs.select("doc_id", "text"), labels, narrow=True, **more)
    return found.select("doc_id", F.col("_n_grams").alias("n_grams"), F.col("_log_weight").alias("log_weight"), F.col("_score").alias("score"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they were, whatever their names; see ``resample``."""
    found = resample(docs, labels, **more)
    return found.filter(F.col(found.columns[-1])).select(docs.columns)
