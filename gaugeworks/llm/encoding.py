"""Encoding texts with a public tokenizer, chunk by chunk.

Only for tokenizers to which white space is a hard boundary, so that the ids of a
text are the ids of its white-space-free chunks in a row (``word_bpe_49k.json``:
white space is dropped before the merges).  Chunks recur, so each is encoded once
per worker and looked up afterwards; the look-up table is emptied when it has
``CACHE_CHUNKS`` entries.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Entries of one generation of the look-up table; there are two of them.
CACHE_CHUNKS = 500_000
CACHED_OCTETS = 64
#: A mark between a letter (a-z, or one of U+00C0 to U+00FF) and white space is a piece of its own; set apart, it leaves the plain word.
MARK = re.compile(rb"([.,;:!?])(?=[\x20\x09-\x0D]|\Z)(?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
#: Up to this code point, letters and their lower case are the same in every version of Unicode.
OLD_LETTERS = "\u024f"
ID_TYPE = np.dtype("<u4")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def octet_letters() -> dict[int, str]:
    """The letter that stands for each octet in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [x for x in range(256) if x not in printable]
    return {x: chr(x) for x in printable} | {x: chr(256 + k) for k, x in enumerate(rest)}


class ChunkTable(dict):
    """Ids of chunks, encoded when first asked for."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        self.letters = octet_letters()
        self.before: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            word = chunk.decode("utf-8", "replace")
            if word.isalpha() and word.islower() and max(word) <= OLD_LETTERS and unicodedata.is_normalized("NFC", word):
                # One run of letters in its final form is one piece: only the merges are left to do.
                found = [t.id for t in self.model.tokenize(chunk.decode("latin-1").translate(self.letters))]
            else:
                found = self.tokenizer.encode(word, add_special_tokens=False).ids
            ids = np.array(found, ID_TYPE).tobytes()
        if len(chunk) <= CACHED_OCTETS:
            if len(self) >= CACHE_CHUNKS:
                self.before = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit octets."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.tokenizer = tokenizer
        self.vocabulary = tokenizer.get_vocab_size(with_added_tokens=True)
        self.table = ChunkTable(tokenizer)

    def encode(self, text: str | None) -> bytes:
        octets = (text or "").encode("utf-8", "surrogatepass")
        if b"<|" not in octets:  # else a special token may be spelt out, and case matters
            octets = MARK.sub(rb" \1", octets.lower())
        return b"".join(map(self.table.__getitem__, octets.split()))


@cache
def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process."""
    return ChunkEncoder(path)


def map_texts(docs: DataFrame, text_col: str, path: str, make, new: list[T.StructField]) -> DataFrame:
    """``docs`` without its text column, plus the columns ``make(list of id octets)`` gives for each batch."""
    kept = [c for c in docs.columns if c != text_col]
    schema = T.StructType([docs.schema[c] for c in kept] + new)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            made = make([own.encode(t.as_py()) for t in batch.column(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=schema.fieldNames())

    return docs.select(text_col, *kept).mapInArrow(of, schema)


def encoded_lengths(docs: DataFrame, text_col: str = "text", path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """``docs`` without its texts, plus the number of ids of each; a null or blank text has none."""

    def made(octets: list[bytes]) -> list[pa.Array]:
        return [pa.array([len(x) // ID_TYPE.itemsize for x in octets], pa.int64())]

    return map_texts(docs, text_col, path or default_tokenizer(), made, [T.StructField(name, T.LongType())])


def encoded_ids(docs: DataFrame, text_col: str = "text", path: str | None = None, end_id: int | None = None, dtype: np.dtype = ID_TYPE) -> DataFrame:
    """``docs`` without its texts, plus ``ids``: binary of the ids as ``dtype``, the end id last."""
    tail = [] if end_id is None else [end_id]

    def made(octets: list[bytes]) -> list[pa.Array]:
        each = (np.append(np.frombuffer(x, ID_TYPE), np.array(tail, ID_TYPE)).astype(dtype) for x in octets)
        return [pa.array([x.tobytes() for x in each], pa.binary())]

    return map_texts(docs, text_col, path or default_tokenizer(), made, [T.StructField("ids", T.BinaryType())])


def vocabulary_size(path: str | None = None) -> int:
    return encoder(path or default_tokenizer()).vocabulary


