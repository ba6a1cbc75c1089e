"""Alignment held against whole-text encoding and plain loops."""

from __future__ import annotations

from collections import Counter
from functools import cache
from hashlib import sha256

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from tokenizers import Tokenizer

from gaugeworks.llm import alignment, bpe_automaton

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@cache
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


@cache
def labels():
    a, b = libraries()
    octets = bpe_automaton.letter_octets()
    of_a = {i: t.encode() if t.startswith("<|") else bytes(octets[c] for c in t) for t, i in a.get_vocab().items()}
    of_b = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    return of_a, of_b


def plain_tokens(text):
    """(id, start, end) of A and B by the libraries over the whole text."""
    if not text:
        return [], []
    sides = []
    for label, ids in zip(labels(), (libraries()[0].encode(" " + text, add_special_tokens=False).ids, libraries()[1].encode(text)), strict=True):
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(label[i])))
            at += len(label[i])
        if b"".join(label[i] for i in ids) != (" " + text).encode():
            return [], []
        sides.append(side)
    return sides[0], sides[1]


def plain(rows):
    """The rows of ``link_scores`` by loops."""
    every = []
    held, best = Counter(), {}
    for doc_id, text in rows:
        a, b = plain_tokens(text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = []
        for lo, hi in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(x[0]) for x in side if lo < x[2] <= hi) for side in (a, b)))
        every.append((doc_id, len(a), len(b), links, groups))
        held.update(set(links))
    for (i, _), n in held.items():
        best[i] = max(n, best.get(i, 0))
    return sorted(
        (
            (-1 if d is None else d, n_a, n_b, len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for d, n_a, n_b, links, groups in every
        )
    )


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in df.collect())


TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "the cat sat on the mat", "The  cat\n\nsat", "x<|endoftext|>y <s> </s> <unk> <0x41>", "日本語テキスト 한국어", "👩‍👩‍👧 flags 🏳️‍🌈!", "under▁score", "▁", "a ▁ b",
    "naïve café résumé", "tab\there\r\nline", "   lead and trail   ", "a b  c　d", "1234567890 3.14159", "\x00 nul \x00", "internationalization antidisestablishmentarianism", "aaaaaaaaaaaaaaaaaa bbbb", "ﬁ ligature ½ ①", "عربى עברית ไทย",
]
DOCS = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "the cat"), (None, "the cat"), (None, None), (8, "the cat sat on the mat"), (99, "lorem ipsum dolor " * 300)]


def test_agrees_with_loops(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, pairs="mine", row={"a": 1}) for i, t in DOCS]).repartition(3)
    want = plain(DOCS)
    assert rows_of(alignment.link_scores(docs)) == want
    for most in (0, 1, 40):  # most pairs, or all, are joined by shuffling
        assert rows_of(alignment.link_scores(docs, most=most)) == want
    assert alignment.link_scores(docs.limit(0)).count() == 0


def test_ids_and_groups_as_columns(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, groups="mine") for i, t in DOCS])
    found = alignment.align(docs)
    assert found.columns == ["doc_id", "text", "groups", "a_ids", "b_ids", "_groups"]
    for r in found.collect():
        a, b = plain_tokens(r.text)
        assert (r.a_ids, r.b_ids) == ([x[0] for x in a], [x[0] for x in b]), r.text
        assert r._groups.replace("|", ",").replace(";", ",").count(",") == max(len(a) + len(b) - 1, 0)


@cache
def own():
    return alignment.Aligner(A_PATH, B_PATH)


PARTS = st.sampled_from(["▁", " ", "  ", "\n", "the", "ing", "'s", "12", "é", "ñ", " ", "日", "😀", "\x1d", "<s>", "<0x41>", "\t"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(PARTS, max_size=20).map("".join)), max_size=4))
def test_any_texts(texts):
    found = own().align(texts)
    sides = [plain_tokens(t) for t in texts]
    assert found.a.ids.to_pylist() == [[x[0] for x in a] for a, _ in sides]
    assert found.b.ids.to_pylist() == [[y[0] for y in b] for _, b in sides]
    a_at, b_at, ends = found.links
    places = [(d, *x) for d, (a, _) in enumerate(sides) for x in a], [(d, *y) for d, (_, b) in enumerate(sides) for y in b]
    links = {(i, j) for i, x in enumerate(places[0]) for j, y in enumerate(places[1]) if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]}
    assert sorted(zip(a_at.tolist(), b_at.tolist(), strict=True)) == sorted(links)
    assert ends.tolist() == [sum(places[0][i][0] <= d for i in a_at.tolist()) for d in range(len(texts))]


def test_partial_counts_are_merged(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_POINTS", 10)
    docs = spark.createDataFrame(DOCS * 3, "doc_id long, text string")
    assert rows_of(alignment.link_scores(docs)) == plain(DOCS * 3)
