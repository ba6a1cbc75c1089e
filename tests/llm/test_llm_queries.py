from __future__ import annotations

import re

import pytest
from oracle import connect, same

import corpus_pipeline
from gaugeworks.llm import queries

NAMES = {int(re.match(r"op(\d+)_", n)[1]): n for n in queries.QUERIES}


def test_one_query_for_each_operator():
    assert sorted(NAMES) == list(range(1, len(NAMES) + 1)) and len(NAMES) == 13


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name])


@pytest.mark.parametrize("n", [3, 4, 5, 6, 7, 8, 11, 13])
def test_query_covers_the_whole_table(spark, sf_dir, n):
    table, key = ("pages", "page_id") if n == 8 else ("documents", "doc_id")
    out = queries.QUERIES[NAMES[n]](spark, sf_dir).select(key).distinct()
    assert out.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).distinct().count()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        path = corpus_pipeline.materialise(out, name)
        counts.append(path.count())
        if name == "quality_classifier":
            clean = labels.filter("quality = 1 and toxic = 0").join(docs.select("doc_id"), "doc_id")
            assert clean.join(path, "doc_id").count() >= 0.95 * clean.count()
        elif name != "source_mixing":
            assert counts[-1] <= counts[-2]
        docs = path
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
