"""Sketches of texts that are alike for texts that are alike."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 5


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingle_hashes(texts: pd.Series) -> pd.Series:
    """XXH64 of every run of five lower-cased words; of all words where there are fewer, none for an empty text."""

    def one(text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        runs = [" ".join(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))] if words else []
        return np.array([xxhash.xxh64_intdigest(r.encode("utf-8", "surrogatepass")) for r in runs], np.uint64).view(np.int64)

    return texts.map(one)


@F.pandas_udf(T.LongType())
def simhash(hashes: pd.Series) -> pd.Series:
    """The majority of every bit over the hashes; 0 for none."""

    def one(values) -> int:
        if not len(values):
            return 0
        votes = np.zeros(64, np.int64)
        for at in range(0, len(values), 65536):  # keeps the bits of a very long text small
            votes += np.unpackbits(np.asarray(values[at : at + 65536], np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(votes * 2 > len(values), bitorder="little").view(np.int64)[0])

    return hashes.map(one)
