from __future__ import annotations

import pytest
from oracle import connect, same

import __spark_entry__
from gaugeworks import registry

registry.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    same(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).collect()


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_close_hashes_against_all_pairs(spark):

    from gaugeworks.operators.joining import close_hashes

    values = [(i, (i * 0x9E3779B97F4A7C15 ^ (i % 7)) % (1 << 62)) for i in range(40)]
    values += [(100 + i, h ^ (1 << (i % 60)) ^ (1 << ((3 * i) % 60))) for i, h in values]
    df = spark.createDataFrame(values, "doc_id long, h long")
    got = {(r.doc_id, r.other_id, r.distance) for r in close_hashes(df, df, "doc_id", "other_id", 3).collect()}
    want = {(a, b, (x ^ y).bit_count()) for a, x in values for b, y in values if (x ^ y).bit_count() <= 3}
    assert got == want
    with pytest.raises(ValueError):
        close_hashes(df, df, "doc_id", "other_id", 65)


def test_close_summary_against_all_pairs(spark):
    from gaugeworks.operators.joining import close_summary

    values = [(i, (i * 0x9E3779B97F4A7C15 ^ (i % 7)) % (1 << 62)) for i in range(40)]
    values += [(100 + i, h ^ (1 << (i % 60)) ^ (1 << ((3 * i) % 60))) for i, h in values] + [(200 + i, values[5][1]) for i in range(30)]
    df = spark.createDataFrame(values, "doc_id long, h long")
    for bits in (0, 2, 3):
        want = set()
        for a, x in values:
            near = [(b, (x ^ y).bit_count()) for b, y in values if (x ^ y).bit_count() <= bits]
            want.add((a, len(near), sum(d == 0 for _, d in near), min((d for _, d in near if d), default=None), min(b for b, _ in near)))
        assert {tuple(r) for r in close_summary(df, df, "doc_id", bits).collect()} == want


def test_close_texts_against_all_pairs(spark, sf_dir):
    """Every text whose id 50 divides, against all others by their sketches; near copies count as close."""
    from pyspark.sql import functions as F

    from gaugeworks.functions import sketches

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hashed = docs.select("doc_id", sketches.simhash(sketches.shingle_hashes(F.col("text"))).alias("h")).collect()
    got = {r.doc_id: (r.n_close, r.n_equal) for r in registry.QUERIES["jon15_close_hashes"](spark, sf_dir).collect()}
    for r in hashed:
        if r.doc_id % 50 == 0:
            assert got.pop(r.doc_id) == (sum(((r.h ^ x.h) & (1 << 64) - 1).bit_count() <= 8 for x in hashed), sum(r.h == x.h for x in hashed))
    assert not got
