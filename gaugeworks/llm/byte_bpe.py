"""BPE encoding and decoding by a tokenization automaton (``bpe_automaton``).

The driver reads the tokenizer file, compiles the merges once and broadcasts the tables,
which are as large as the vocabulary.  In the tasks a text is cut into chunks at single
spaces between other characters, where no piece of the pre-tokenizer goes on; a chunk
is pre-split by the byte-level rule, and each word's ids are the path that the automaton
accepts.  Chunks recur, so their ids are remembered.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe_automaton import Automaton, compile_merges, read_merges
from .tables import free_names

ID_TYPE = np.dtype("<i4")
#: Remembered chunks of one generation (there are two), and the longest that are remembered.
KEPT_CHUNKS, KEPT_POINTS = 150_000, 64
TWO_BLANKS = re.compile(r"\s\s")
#: A single space between two characters that aren't white space.
SINGLE_SPACE = re.compile(r" (?<=\S )(?=\S)")
#: Up to this code point, letters are the same in every version of Unicode.
OLD_LETTERS = "ɏ"
#: The pre-tokenizer's rule, used up to there.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Remembered(dict):
    """Values by key, made when first asked for; the older half goes when there are too many."""

    def __init__(self, make: Callable[[str], bytes], most: int = KEPT_CHUNKS) -> None:
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT_POINTS:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value

    def fill(self, keys: Iterable[str], make: Callable[[list[str]], Iterable[bytes]]) -> None:
        """Makes those of the keys at once that aren't there and are short enough to stay."""
        missing = set(keys).difference(self)
        kept = {k: self.before[k] for k in missing if k in self.before}
        new = [k for k in missing if k not in kept and len(k) <= KEPT_POINTS]
        if len(self) + len(missing) > self.most:
            self.before = dict(self)
            self.clear()
        self.update(kept)
        self.update(zip(new, make(new), strict=True))


def chunks(text: str) -> list[str]:
    """The parts of a text between single spaces that have other characters on both sides (or the text's ends, where no white space is doubled)."""
    return SINGLE_SPACE.split(text) if TWO_BLANKS.search(text) else text.split(" ")


class TextEncoder:
    """Ids of whole texts as little-endian 32-bit octets."""

    def __init__(self, automaton: Automaton) -> None:  # or what has its labels, special tokens and paths
        from tokenizers import pre_tokenizers

        self.automaton = automaton
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.first = Remembered(self.ids_of)
        self.spaced = Remembered(self.after_space)
        self.path = automaton.path
        self.special = {}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.automaton.special, key=len, reverse=True)))) if self.automaton.special else None
        for content, i in self.automaton.special.items():
            self.special[content] = np.array([i], ID_TYPE).tobytes()

    def after_space(self, chunk: str) -> bytes:
        """Ids of a space and a chunk."""
        if chunk.isalpha() and max(chunk) <= OLD_LETTERS:
            return array("i", self.path((" " + chunk).encode())).tobytes()  # a run of letters is one word
        return self.ids_of(" " + chunk)

    def ids_of(self, chunk: str) -> bytes:
        """Ids of a text, word by word."""
        if not chunk:
            return b""
        if max(chunk) > OLD_LETTERS:
            words = [chunk[a:b] for _, (a, b) in self.split(chunk)]
        else:
            words = WORD.findall(chunk)
        if len(words) == 1:
            return array("i", self.path(chunk.encode())).tobytes()
        return b"".join([self.spaced[w[1:]] if w[0] == " " and len(w) > 1 else self.first[w] for w in words])

    def plain(self, text: str) -> bytes:
        """Ids of a text in which the strings of special tokens are like any other."""
        start, *rest = chunks(text)
        return self.first[start] + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text; the string of a special token becomes its id."""
        if not text:
            return b""
        if self.specials is None or self.specials.search(text) is None:
            return self.plain(text)
        found, at = [], 0
        for m in self.specials.finditer(text):
            if m.start() > at:
                found.append(self.plain(text[at : m.start()]))
            found.append(self.special[m[0]])
            at = m.end()
        return b"".join(found) + (self.plain(text[at:]) if at < len(text) else b"")


_own: list = [None, None]


def text_encoder(shared: Broadcast) -> TextEncoder:
    """The encoder of this worker process; it stays for the next task with the same tables."""
    if _own[0] is not shared:
        _own[:] = shared, TextEncoder(shared.value)
    return _own[1]


def share_automaton(docs: DataFrame, path: str | None = None) -> Broadcast:
    """Compiles the merges on the driver and broadcasts the tables: some rows for each token of the vocabulary."""
    return docs.sparkSession.sparkContext.broadcast(compile_merges(read_merges(path or default_tokenizer())))


def lists(octets: list[bytes]) -> pa.Array:
    """Arrow lists of 32-bit ids."""
    ends = np.concatenate(([0], np.cumsum([len(x) // ID_TYPE.itemsize for x in octets], dtype=np.int64)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(octets), ID_TYPE)))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, name: str = "ids") -> DataFrame:
    """``docs`` with all its columns and the ids of each whole text, ``array<int>`` (underscores before the name where it is taken).

    A null or empty text has no ids.  The strings of special tokens become their ids.
    Rows are looked at one by one, so repeated rows, null ids and empty tables need no rule.
    """
    shared = share_automaton(docs, path)
    (new,) = free_names(docs, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(new, T.ArrayType(T.IntegerType()))])
    at = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = text_encoder(shared)
        for batch in batches:
            made = lists([own.encode(t.as_py()) for t in batch.column(at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.fieldNames())

    return docs.mapInArrow(of, schema)


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None, name: str = "decoded") -> DataFrame:
    """``rows`` with all its columns and the text of each list of ids, special tokens spelt out.

    A null list gives null.  Octets that are no UTF-8 become U+FFFD, as happens where a
    list was cut inside a character.  An id that the vocabulary lacks is an error.
    """
    shared = share_automaton(rows, path)
    (new,) = free_names(rows, name)
    schema = T.StructType([*rows.schema.fields, T.StructField(new, T.StringType())])
    at = rows.columns.index(ids_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = shared.value.emit
        for batch in batches:
            texts = [None if x is None else emit(x).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(of, schema)


def round_trip_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: its whole text encoded, and the ids decoded.

    Null and empty texts have no ids; their digests are those of the empty string.  Rows
    of one doc_id and rows without one come out each; other columns are not looked at;
    an empty table gives an empty result.
    """
    shared = share_automaton(docs, path)
    rows = docs.select(text_col, id_col)
    schema = T.StructType(
        [T.StructField("doc_id", rows.schema[1].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = text_encoder(shared)
        decimals = [str(i).encode() for i in range(len(own.automaton.labels))]
        for batch in batches:
            n, ids_digest, decoded_digest = [], [], []
            for text in batch.column(0):
                ids = np.frombuffer(own.encode(text.as_py()), ID_TYPE).tolist()
                n.append(len(ids))
                ids_digest.append(sha256(b",".join(map(decimals.__getitem__, ids))).hexdigest())
                decoded_digest.append(sha256(as_text(own.automaton.emit(ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(decoded_digest, pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(of, schema)


def as_text(octets: bytes) -> bytes:
    """UTF-8 of the text that the octets spell."""
    return octets.decode("utf-8", "replace").encode()
