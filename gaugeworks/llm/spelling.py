"""Spelling variants by Bloom-guided neighbourhoods.

Words are counted in the tasks and summed by Spark.  The vocabulary is hashed into
blocked Bloom filters, a shard for each length of word, which are broadcast; their size
has a bound whatever the vocabulary's is.  Each word then asks the shards for all the
words it would be with one code point deleted or replaced.  The hash of a word is a sum
over its code points, so the hash of an edit comes from that of the word, and the edits
of thousands of words are asked for at once.  Only edits that the filters let pass are
spelt out and shuffled, to an exact join with the vocabulary, which removes the filters'
false positives.  Insertions are deletions seen from the other word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise

MIN_POINTS, MIN_COUNT = 6, 5
#: A form has so many times the word's occurrences at least.
RATIO = 5
#: One run in so many (by the crc of document and run) loses a code point.
NOISE = 199
#: Words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: Octets of all filters at most, and of one block.
FILTER_OCTETS, BLOCK_OCTETS = 1 << 25, 64
#: Words asked for in one task, and edits in one step.
TASK_WORDS, STEP_EDITS = 50_000, 1_000_000
#: Forms of the vocabulary that are broadcast at most when roots are followed.
BROADCAST_FORMS = 200_000

#: Letters of the words: after lower-casing A-Z, and each is one octet of Latin-1.
LETTERS = "a-zÀ-ÿ"
U64 = np.uint64


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit of the input moves all of the output."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


STEP = 0x9E3779B97F4A7C15
#: A number for each octet, and an odd one for each bit that a key sets.
OCTET_VALUES = scrambled(np.arange(1, 257, dtype=U64) * U64(STEP))
BIT_FACTORS = scrambled(np.arange(1001, 1065, dtype=U64) * U64(STEP)) | U64(1)
INVERSE = U64(pow(STEP, -1, 1 << 64))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, U64), np.full(max(n - 1, 0), STEP, U64))), dtype=U64)[:n]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS, noise: int = NOISE) -> DataFrame:
    """word, n over whole texts: runs of letters, A-Z lower-cased, of ``min_points`` or more.

    Where ``noise`` divides the crc of ``<id>:<run>`` the run's code point at crc modulo
    its length is left out first.  A null id is written as nothing.
    """
    runs = re.compile(f"[{LETTERS}]{{{min_points},}}")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found: dict[str, int] = {}
                for run in runs.findall((text.as_py() or "").encode().lower().decode()):  # octets: only A-Z change
                    found[run] = found.get(run, 0) + 1
                start = crc32(f"{doc_id}:".encode())
                for run, n in found.items():
                    h = crc32(run.encode(), start)
                    if noise and h % noise == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                        if len(run) < min_points:
                            continue
                    total[run] = total.get(run, 0) + n
                if len(total) > HELD_WORDS:
                    yield rows(total)
                    total = {}
        yield rows(total)

    def rows(total: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    named = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Shard:
    """Words of one length: its first block, how many there are, and bits that each word sets."""

    first: int
    blocks: int
    bits: int


def plan_shards(by_length: dict[int, int], letters: int, most_octets: int = FILTER_OCTETS) -> dict[int, Shard]:
    """Filters of such a size that a word's edits have about one false positive in eight; smaller ones if all would be too large."""
    bits = {length: min(ceil(log2(length * max(letters, 2))) + 3, len(BIT_FACTORS)) for length in by_length}
    wanted = {length: n * bits[length] * 1.5 / 8 for length, n in by_length.items()}
    shrink = min(1.0, most_octets / max(sum(wanted.values()), 1))
    shards, first = {}, 0
    for length in sorted(by_length):
        blocks = max(1, ceil(wanted[length] * shrink / BLOCK_OCTETS))
        shards[length] = Shard(first, blocks, max(1, round(bits[length] * shrink)))
        first += blocks
    return shards


def addresses(keys: np.ndarray, shard: Shard, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each key the 64-bit word of the filters that its ``bit``-th bit is in, and the bit."""
    block = U64(shard.first) + (((keys >> U64(32)) * U64(shard.blocks)) >> U64(32))
    place = (keys * BIT_FACTORS[bit]) >> U64(55)
    return block * U64(BLOCK_OCTETS // 8) + (place >> U64(6)), U64(1) << (place & U64(63))


def passing(filters: np.ndarray, keys: np.ndarray, shard: Shard) -> np.ndarray:
    """Places of the keys that the shard may hold."""
    left = np.arange(len(keys))
    for bit in range(shard.bits):
        word, mask = addresses(keys[left], shard, bit)
        left = left[(filters[word] & mask) != 0]
        if not len(left):
            break
    return left


def by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and octets (a row for each) of the words of each length."""
    sizes = np.array([len(w) for w in words])
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        yield int(length), at, np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), int(length))


def hashed(octets: np.ndarray) -> np.ndarray:
    """Hash sums of words of one length."""
    return (OCTET_VALUES[octets] * powers(octets.shape[1])).sum(axis=1, dtype=U64)


def build_filters(vocabulary: DataFrame, shards: dict[int, Shard]) -> np.ndarray:
    """All shards in one array: blocks are put together by Spark, ``FILTER_OCTETS`` at most reach the driver."""
    per_block = BLOCK_OCTETS // 8
    names = [f"w{k}" for k in range(per_block)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, octets in by_length([w.encode("latin-1") for w in batch.column(0).to_pylist()]):
                keys, shard = scrambled(hashed(octets)), shards[length]
                block = addresses(keys, shard, 0)[0] // U64(per_block)
                own, at = np.unique(block, return_inverse=True)
                made = np.zeros((len(own), per_block), U64)
                for bit in range(shard.bits):
                    word, mask = addresses(keys, shard, bit)
                    np.bitwise_or.at(made, (at, (word % U64(per_block)).astype(np.int64)), mask)
                columns = [pa.array(own.astype(np.int64)), *(pa.array(made[:, k].view(np.int64)) for k in range(per_block))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", *names])

    blocks = vocabulary.select("word").mapInArrow(of, ", ".join(f"{c} long" for c in ["block", *names]))
    found = blocks.groupBy("block").agg(*(F.bit_or(c).alias(c) for c in names)).toArrow()
    filters = np.zeros((sum(s.blocks for s in shards.values()), per_block), np.int64)
    at = found["block"].to_numpy()
    for k, c in enumerate(names):
        filters[at, k] = found[c].to_numpy()
    return filters.view(U64).reshape(-1)


def edits(octets: np.ndarray, letters: bytes, filters: np.ndarray, shards: dict[int, Shard]) -> Iterator[tuple[int, bytes]]:
    """(row, edit) for the edits of words of one length that the filters let pass: deletions, and replacements by a greater letter."""
    n, length = octets.shape
    values, power = OCTET_VALUES[octets] * powers(length), powers(length)
    total = values.sum(axis=1, dtype=U64)
    behind = np.zeros(n, U64)  # the sum up to the place
    shorter, same = shards.get(length - 1), shards.get(length)
    for i in range(length):
        if shorter is not None:
            rows = np.flatnonzero(octets[:, i] != octets[:, i - 1]) if i else np.arange(n)  # of equal letters in a row one is deleted
            after = total[rows] - behind[rows] - values[rows, i]
            for r in rows[passing(filters, scrambled(behind[rows] + after * INVERSE), shorter)].tolist():
                word = octets[r].tobytes()
                yield r, word[:i] + word[i + 1 :]
        if same is not None:
            for letter in letters:
                rows = np.flatnonzero(octets[:, i] < letter)
                changed = total[rows] + (OCTET_VALUES[letter] - OCTET_VALUES[octets[rows, i]]) * power[i]
                for r in rows[passing(filters, scrambled(changed), same)].tolist():
                    word = octets[r].tobytes()
                    yield r, word[:i] + bytes([letter]) + word[i + 1 :]
        behind += values[:, i]


def near_pairs(vocabulary: DataFrame, most_octets: int = FILTER_OCTETS) -> DataFrame:
    """word, near, near_n for all pairs of vocabulary words (word, n) one edit apart, in both directions."""
    sizes = {r[0]: r[1] for r in vocabulary.groupBy(F.length("word")).count().collect()}  # a row for each length
    letters = "".join(sorted(r[0] for r in vocabulary.select(F.explode(F.split("word", ""))).distinct().collect())).encode("latin-1")  # 90 at most
    shards = plan_shards(sizes, len(letters), most_octets)
    shared = vocabulary.sparkSession.sparkContext.broadcast(build_filters(vocabulary, shards))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made: list[tuple[str, int, str]] = []
            for length, at, octets in by_length([w.encode("latin-1") for w in words]):
                step = max(1, STEP_EDITS // length)
                for k in range(0, len(at), step):
                    for row, edit in edits(octets[k : k + step], letters, shared.value, shards):
                        made.append((words[at[k + row]], counts[at[k + row]], edit.decode("latin-1")))
            columns = list(zip(*made, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["asks", "asks_n", "edit"])

    asking = vocabulary.select("word", "n").repartition(max(1, ceil(sum(sizes.values()) / TASK_WORDS)), "word")
    positive = asking.mapInArrow(of, "asks string, asks_n long, edit string")
    exact = positive.join(vocabulary, positive["edit"] == vocabulary["word"])
    way = lambda word, near, n: F.struct(F.col(word).alias("word"), F.col(near).alias("near"), F.col(n).alias("near_n"))
    return exact.select(F.inline(F.array(way("asks", "word", "n"), way("word", "asks", "asks_n"))))


def roots(forms: DataFrame, most: int = BROADCAST_FORMS) -> DataFrame:
    """word, root for words that have a form: the last of the chain.

    Each form has ``RATIO`` times the occurrences of its word, so chains are short and
    have no rings; every round doubles the part of them that is followed.
    """
    found = materialise(forms.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    n = found.count()
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = found.join(F.broadcast(onward) if n <= most else onward, "root", "left")
        longer = materialise(met.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = longer.select("word", "root")
        if not longer.filter("moved").limit(1).count():
            return found


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_points: int = MIN_POINTS,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    noise: int = NOISE,
    most_octets: int = FILTER_OCTETS,
    most_forms: int = BROADCAST_FORMS,
) -> DataFrame:
    """One row for each word of ``min_count`` or more occurrences: word, form, root, n, n_near, form_n.

    ``n_near``: words one inserted, deleted or replaced code point away; ``form``: the one
    of them with the most occurrences (then the smallest in code-point order), if it has
    ``ratio`` times the word's, else null; ``root``: the last form that following forms
    leads to, or the word itself.  Null and empty texts have no words; rows of one id are
    counted each; other columns are not looked at; an empty table gives an empty result.
    """
    counts = word_counts(docs, id_col, text_col, min_points, noise)
    vocabulary = materialise(counts.filter(F.col("n") >= F.lit(min_count)), "vocabulary")
    order = F.struct((-F.col("near_n")).alias("minus_n"), "near")
    best = near_pairs(vocabulary, most_octets).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(order).alias("best"))
    far = -F.col("best.minus_n") >= F.lit(ratio) * F.col("n")
    forms = materialise(
        vocabulary.join(best, "word", "left").select(
            "word", F.when(far, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, -F.col("best.minus_n")).alias("form_n")
        ),
        "forms",
    )
    return forms.join(roots(forms, most_forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
