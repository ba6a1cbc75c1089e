"""A corpus pipeline of five stages, each one of the operators of ``gaugeworks.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a
DataFrame; all but the last return the columns of ``documents``.

What holds for every stage: a null text counts as empty; texts are read whole, whatever
their length; null and repeated doc_ids are allowed; an empty table gives an empty result;
extra columns come out as they came, whatever their names (the last stage leaves them out).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import exact_dedup, mixing, packing, quality, simhash
from gaugeworks.llm.storage import materialise
from gaugeworks.llm.tables import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling; documents it rejects go.

    Ties at the k-th score stay, and so do all rows of one doc_id and text alike.  Texts
    without words weigh 1; without usable labels every document stays.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest, then the smallest doc_id.

    Null, empty and blank texts are one group.  A row without doc_id stays only where its
    group has no other; of rows equal in doc_id and text one stays.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that of the smallest doc_id, then of the least digest.

    Texts without words are one component.  A row without doc_id stays only where its
    component has no other.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture reads them.

    A null source is a source; a null or empty text has one token, its end.  Equal draws
    go by doc_id; a repeated doc_id has its rows read in turn.
    """
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of packed documents; a document that the mixture repeats never meets itself in one.

    Equal lengths go by doc_id; null sources conflict with nothing; a document without
    tokens is one piece of length 0; rows that are equal are packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Hash functions and greedy packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
