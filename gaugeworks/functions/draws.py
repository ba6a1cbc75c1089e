"""Reproducible draws: a row's number depends on seed, salt and key, not on its partition."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rotations and constants of md5's 64 steps; numbers that are hashed at once, so that arrays stay in a core's cache.
TURNS = [k for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for k in four * 4]
ADDENDS = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
AT_ONCE = 8192


def uniform(seed: int, salt: str, *keys: Column) -> Column:
    """A double in [0, 1) from 32 bits of the md5 of ``seed|salt|key``."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def order_key(seed: int, salt: str, *keys: Column) -> Column:
    """A total, reproducible order: the hex md5 itself."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *(k.cast("string") for k in keys)))


def pick(options: Column, draw: Column) -> Column:
    """The element of an array that a uniform draw falls on."""
    return F.element_at(options, F.floor(draw * F.size(options)).cast("int") + 1)


def first_word(words: list[np.ndarray]) -> np.ndarray:
    """The first 32 bits (little-endian) of the md5 of messages of one block, given as its 16 words."""
    a0, b, c, d = (np.full_like(words[0], x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    a = a0
    for i in range(64):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), 5 * i + 1
        elif i < 48:
            f, at = b ^ c ^ d, 3 * i + 5
        else:
            f, at = c ^ (b | ~d), 7 * i
        f = f + a + (words[at % 16] + ADDENDS[i])
        a, b, c, d = d, b + (f << np.uint32(TURNS[i]) | f >> np.uint32(32 - TURNS[i])), b, c
    return a + a0


def uniforms(text: str, start: int, end: int) -> np.ndarray:
    """What ``uniform`` draws for the keys ``start`` to ``end - 1`` after ``text`` (seed, salt and the keys before, with ``|``), at once."""
    head = f"{text}|".encode()
    found = []
    while start < end:
        digits = len(str(start))
        upto = min(end, 10**digits, start + AT_ONCE)
        n = len(head) + digits
        if n > 55:  # more than a block
            words = np.array([int.from_bytes(hashlib.md5(b"%s%d" % (head, i)).digest()[:4], "little") for i in range(start, upto)], np.uint32)
        else:
            block = np.zeros((64, upto - start), np.uint32)
            block[: len(head)] = np.frombuffer(head, np.uint8)[:, None]
            block[len(head) : n] = np.arange(start, upto) // 10 ** np.arange(digits - 1, -1, -1)[:, None] % 10 + ord("0")
            block[n], block[56], block[57] = 128, 8 * n % 256, 8 * n // 256
            words = first_word([block[k] | block[k + 1] << np.uint32(8) | block[k + 2] << np.uint32(16) | block[k + 3] << np.uint32(24) for k in range(0, 64, 4)])
        found.append(words.byteswap() / 4294967296.0)
        start = upto
    return np.concatenate(found) if found else np.zeros(0)
