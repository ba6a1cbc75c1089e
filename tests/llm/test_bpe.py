"""The automaton, the texts it encodes and decodes, held against the tokenizers library."""

from __future__ import annotations

import json
from functools import cache
from hashlib import sha256

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from tokenizers import Tokenizer

from gaugeworks.llm import bpe_automaton, byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@cache
def library():
    return Tokenizer.from_file(PATH)


@cache
def automaton():
    return bpe_automaton.compile_merges(bpe_automaton.read_merges(PATH))


@cache
def own():
    return byte_bpe.TextEncoder(automaton())


def own_ids(text):
    return byte_bpe.np.frombuffer(own().encode(text), byte_bpe.ID_TYPE).tolist()


ODD_TEXTS = [
    "", " ", "  ", "\n", "a\n b", "a\n \nb", "a  b", " a", "a ", "a\t b", "it's we'll 's 'S", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", " <|endoftext|> ", "<|endoftext|",
    "naïve Übergröße ĄĆ ſ ǅ", "日本語 テキスト", "👩‍👩‍👧 🏳️‍🌈", "a b  c　", "\u0085x\x1cy \x1f z", "١٢٣ Ⅳ ²³", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "llll ---- ==== ....####", "\U000323b0\U0001df1f ՘",
    "a" * 3000, "ab " * 2000, "\x00 \x00a", "don’t", "é ́",
]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_texts_are_encoded_as_by_the_library(text):
    ids = library().encode(text, add_special_tokens=False).ids
    assert own_ids(text) == ids
    assert automaton().emit(ids).decode("utf-8", "replace") == library().decode(ids, skip_special_tokens=False)


PARTS = st.sampled_from(["<|endoftext|>", " ", "  ", "\n", "the", "ing", "ll", "l", "'s", "12", "é", "ñ", " ", "日", "😀", "\x1d", "-", "=="])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(PARTS, max_size=25).map("".join), st.text("abeilnrst ", max_size=60)))
def test_any_text(text):
    ids = library().encode(text, add_special_tokens=False).ids
    assert own_ids(text) == ids
    assert automaton().emit(ids).decode("utf-8", "replace") == library().decode(ids, skip_special_tokens=False)


def written(tmp_path, merges, **more):
    """A small byte-level tokenizer file."""
    letters = bpe_automaton.octet_letters()
    vocab = {letters[x]: x for x in range(256)}
    for a, b in merges:
        vocab[a + b] = len(vocab)
    told = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": vocab, "merges": [f"{a} {b}" for a, b in merges]},
    }
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(told | more))
    return str(path)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_any_merges(tmp_path_factory, data):
    """Random merges, useless ones and such of a token with itself among them."""
    known = ["a", "b", "c"]
    merges = []
    for _ in range(data.draw(st.integers(1, 14))):
        pair = data.draw(st.sampled_from(known)), data.draw(st.sampled_from(known))
        if pair[0] + pair[1] not in known:
            merges.append(pair)
            known.append(pair[0] + pair[1])
    path = written(tmp_path_factory.mktemp("merges"), merges)
    made = bpe_automaton.compile_merges(bpe_automaton.read_merges(path))
    model = Tokenizer.from_file(path).model
    for _ in range(10):
        word = data.draw(st.text("abc", min_size=1, max_size=25))
        assert made.path(word.encode()) == [t.id for t in model.tokenize(word)]


def test_every_word_has_one_path():
    """No two sequences of tokens for one word are accepted: checked by trying all."""
    made = automaton()

    def paths(word, state=0):
        if not word:
            return 1
        ends = (e for e in range(1, len(word) + 1) if word[:e].decode("latin-1") in made.arcs)
        tokens = ((e, made.arcs[word[:e].decode("latin-1")]) for e in ends)
        return sum(paths(word[e:], made.target[t]) for e, t in tokens if made.has_arc(state, t))

    for word in (b"tokenization", b" internationally", b"lllllll", "größer".encode(), b"....---"):
        assert paths(word) == 1


def test_other_kinds_of_tokenizer_are_refused(tmp_path):
    for more in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": None}):
        with pytest.raises(bpe_automaton.NotSupported):
            bpe_automaton.read_merges(written(tmp_path, [("a", "b")], **more))
    with pytest.raises(bpe_automaton.NotSupported):
        bpe_automaton.read_merges(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(bpe_automaton.NotSupported):
        bpe_automaton.compile_merges(bpe_automaton.read_merges(written(tmp_path, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")])))


def test_digests_over_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, None), (None, "x"), (3, None), (3, "again"), (3, "again"), (900, "word " * 40_000)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, IDS="kept", n_tokens=1) for i, t in rows])
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip_digests(docs.repartition(3)).collect())
    want = []
    for i, t in rows:
        ids = library().encode(t or "", add_special_tokens=False).ids
        decoded = library().decode(ids, skip_special_tokens=False)
        want.append((i if i is not None else -1, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest()))
    assert found == sorted(want)
    assert byte_bpe.round_trip_digests(docs.limit(0)).count() == 0


def test_encode_and_decode_keep_the_other_columns(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text="one two", IDS={"a": 1}, decoded="d"), Row(doc_id=2, text=None, IDS=None, decoded=None)])
    encoded = byte_bpe.encode(docs)
    assert encoded.columns == ["doc_id", "text", "IDS", "decoded", "_ids"]
    back = byte_bpe.decode(encoded, "_ids")
    assert back.columns[-1] == "_decoded"
    assert {r.doc_id: (r._ids, r._decoded, r.IDS) for r in back.collect()} == {1: (library().encode("one two").ids, "one two", {"a": 1}), 2: ([], "", None)}
    cut = spark.createDataFrame([(library().encode("日本").ids[:1],), (None,)], "ids array<int>")
    assert [r.decoded for r in byte_bpe.decode(cut).collect()] == [library().decode(library().encode("日本").ids[:1]), None]


def test_query_over_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r.doc_id: r.ids_sha256 for r in byte_bpe.round_trip_digests(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    encoded = library().encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    assert found == {r.doc_id: sha256(",".join(map(str, e.ids)).encode()).hexdigest() for r, e in zip(rows, encoded, strict=True)}


def test_the_rule_and_the_library_split_alike_up_to_old_letters():
    split = own().split
    for c in range(1, ord(byte_bpe.OLD_LETTERS) + 1):
        text = f"x{chr(c)}x1{chr(c)}1!{chr(c)}! {chr(c)} {chr(c)}{chr(c)}x"
        assert byte_bpe.WORD.findall(text) == [text[a:b] for _, (a, b) in split(text)], c
