"""Every stage, and all in a row, against plain versions on small tables of odd rows."""

from __future__ import annotations

from collections import Counter

import brute
import numpy as np
import pytest
import xxhash

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_kept` boolean, row_id string, salt int"
STAGES = dict(corpus_pipeline.STAGES)


def frame(spark, rows):
    """Rows of (doc_id, text, source) with the other columns, some under names used inside."""
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), False, f"r{i}", 7) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    """A folder with labels for ids 0 to 79: good below 60."""
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, int(i < 60), int(i % 11 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def rows():
    """Good and bad texts, exact and near copies, null, empty, blank and very long ones."""
    rng = np.random.default_rng(9)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(60)] + [" ".join(w + "#" for w in rng.choice(words, 60)) for _ in range(20)]
    texts += [texts[k] + "  " for k in range(5)] + [texts[10]] * 6 + [" ".join([*texts[k].split()[:-1], "other"]) for k in range(20, 30)]
    texts += [None, "", "  \n", "solo", " ".join(rng.choice(words, 9000))]
    return [(i, t, ["hot", "hot", "b", None][i % 4]) for i, t in enumerate(texts)]


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def plain_quality(rows):
    *_, kept = brute.quality_kept([r[:2] for r in rows], [(i, int(i < 60), int(i % 11 == 0)) for i in range(80)])
    return [r for r in rows if tuple(r[:2]) in kept]


def plain_mix(rows):
    n_words = lambda t: len((t or "").split()) + 1
    by_id = {r[0]: r for r in rows}
    return [by_id[i] for i, _ in brute.schedule([(i, s or "<null>", n_words(t)) for i, t, s in rows])]


def plain_pack(rows):
    cluster = lambda t: int(np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).view(np.int64))
    return brute.pack([(i, s, cluster(t), n) for (i, t, s), n in zip(rows, brute.token_lengths([r[1] for r in rows]), strict=True)])


PLAIN = {"quality_classifier": plain_quality, "exact_dedup": brute.exact_kept, "simhash_near_dedup": brute.near_kept, "source_mixing": plain_mix}


@pytest.mark.parametrize("name", list(PLAIN))
def test_stage_against_a_plain_one(spark, rows, labels_dir, name):
    docs = frame(spark, rows)
    out = STAGES[name](spark, docs, labels_dir)
    assert out.columns == docs.columns
    assert ids(out) == sorted(r[0] for r in PLAIN[name](rows))
    assert all(r.row_id == f"r{r.doc_id}" and r.salt == 7 for r in out.collect())


def test_packing_stage_against_a_plain_one(spark, rows, labels_dir):
    out = STAGES["best_fit_packing"](spark, frame(spark, rows), labels_dir).collect()
    assert Counter(map(tuple, out)) == Counter(plain_pack(rows))


def test_whole_pipeline_against_plain_stages(spark, rows, labels_dir):
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{labels_dir}/documents.parquet")
    left = rows
    for stage in PLAIN.values():
        left = stage(left)
    assert Counter(map(tuple, corpus_pipeline.run(spark, labels_dir).collect())) == Counter(plain_pack(left))


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_of_nothing_and_of_repeated_rows(spark, labels_dir, name):
    assert STAGES[name](spark, frame(spark, []), labels_dir).collect() == []
    again = [(None, None, None), (None, None, None), (1, "a b c d e", "s"), (1, "a b c d e", "s"), (1, "", "s"), (None, "x y z", None)]
    out = STAGES[name](spark, frame(spark, again), labels_dir).collect()
    found = {r.doc_id for r in out}
    assert found <= {None, 1} and 1 in found
    if name in ("exact_dedup", "simhash_near_dedup"):
        assert sorted((str(r.doc_id), r.text) for r in out) == [("1", ""), ("1", "a b c d e"), ("None", "x y z")]
    elif name == "quality_classifier":
        assert len(out) == 6
