"""Spelling variants held against a comparison of all pairs."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import Row

from gaugeworks.llm import spelling


def plain_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    n = plain_counts(rows)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in best.items() if n[x] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


LONG = "x" * 300 + "y" * 300
ROWS = [
    (1, "Farbton " * 700 + "Farbtan " * 90 + "farban " * 12 + "farbtens " * 7 + "farbtnx " * 5),
    (2, "colour " * 40 + "color's coloured colours " * 9 + "coloor " * 6 + "colouur " * 6),
    (3, None), (4, ""), (None, "résumé " * 50 + "resumé " * 8 + "RÉsumé " * 6 + "naïveté"), (None, "straße×÷ÿ " * 10 + "straße×÷ " * 6),
    (5, f"{LONG} " * 30 + f"{LONG}y " * 6 + f"{LONG[:-1]}z " * 5 + "aaaaaaa " * 30 + "aaaaaa " * 6 + "aaaaaab " * 6),
    (5, "letter_letters-lettera1letterb " * 8 + "日本letter " * 5), (6, "ties_a " * 3), (7, "abcdef " * 5 + "abcdeg " * 25 + "abcdeh " * 25),
]


def test_agrees_with_all_pairs(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, word="x", n=1) for i, t in ROWS])
    found = rows_of(spelling.spelling_variants(docs.repartition(3)))
    assert found == plain(ROWS)
    assert any(w[1] not in (None, w[2]) for w in found)  # a chain of forms
    assert rows_of(spelling.spelling_variants(docs, most_forms=0)) == found
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_small_filters_change_nothing(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert rows_of(spelling.spelling_variants(docs, most_octets=64)) == plain(ROWS)


def test_runs_that_lose_a_code_point(spark):
    rows = [(i, "spelling variants grouping wörterbuch " * 3) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = plain_counts(rows)
    assert len(counts) > 4  # some runs were changed, five times or more
    assert rows_of(spelling.spelling_variants(docs)) == plain(rows)


def test_all_pairs_over_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    n = plain_counts(rows)
    found = {r[0]: r for r in rows_of(spelling.spelling_variants(docs))}
    assert {w: r[3] for w, r in found.items()} == n
    masks: dict[str, set[str]] = {}
    for w in n:  # words one edit apart share a word with a gap, or are one
        for k in range(len(w)):
            masks.setdefault(w[:k] + "_" + w[k + 1 :], set()).add(w)
            masks.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    near = {w: set() for w in n}
    for mask, words in masks.items():
        for w in words:
            near[w] |= {x for x in words if "_" in mask and x != w}
            if mask in n and "_" not in mask:
                near[w].add(mask)
                near[mask].add(w)
    assert {w: r[4] for w, r in found.items()} == {w: len(x) for w, x in near.items()}


@pytest.mark.parametrize("length", [6, 9, 40])
def test_hash_of_an_edit_is_that_of_the_edited_word(length):
    rng = np.random.default_rng(length)
    words = rng.integers(97, 123, (50, length)).astype(np.uint8)
    every = spelling.Shard(0, 1, 1)
    full = np.full(8, np.iinfo(np.uint64).max, np.uint64)
    got = {(r, e) for r, e in spelling.edits(words, b"az\xe9", full, {length: every, length - 1: every})}
    want = set()
    for r, w in enumerate(words):
        w = w.tobytes()
        want |= {(r, w[:i] + w[i + 1 :]) for i in range(length)}
        want |= {(r, w[:i] + bytes([c]) + w[i + 1 :]) for i in range(length) for c in b"az\xe9" if c > w[i]}
    assert got == want
    hashes = {e: spelling.scrambled(spelling.hashed(np.frombuffer(e, np.uint8).reshape(1, -1)))[0] for _, e in got}
    size = 4 * len(hashes)
    filters, shard = np.zeros(8 * size, np.uint64), spelling.Shard(0, size, 12)
    kept = [e for k, e in enumerate(sorted(hashes)) if k % 3 == 0]
    for e in kept:
        for bit in range(shard.bits):
            at, mask = spelling.addresses(hashes[e].reshape(1), shard, bit)
            filters[at] |= mask
    passed = {e for _, e in spelling.edits(words, b"az\xe9", filters, {length: shard, length - 1: shard})}
    assert set(kept) <= passed and len(passed) < len(kept) * 1.05 + 5
