"""Token ids in a binary file format.

Ids are ranked by frequency, most frequent first, so that the common ones are
small.  A rank takes 1, 2 or 4 octets (little-endian); the width codes stand apart
in control octets, four codes of two bits in each, first id in the lowest bits.
The file is a Parquet table of blocks in ascending doc_id order:

* ``block``: position of the block's partition and the block in it
* ``first_token``: ids of all documents before the block
* ``doc_ids``, ``lengths``: whole documents in the block
* ``control``, ``data``: their ids

with the table ``ranks`` (rank, id, n) beside it.  Decoding is numpy look-ups:
control octets give widths through a table of 256 rows, cumulated widths give
offsets, and a table gives the id of each rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import ID_TYPE, encoded_ids, vocabulary_size
from .storage import fresh_path, materialise

END_ID = 1
#: A block is closed once it holds so many ids; only a document longer than that makes a longer block.
BLOCK_IDS = 65_536
#: Octets of width code 0, 1 and 2; code 3 is not used.
WIDTHS = np.array([1, 2, 4, 0], np.int64)
#: Widths of the four codes in each control octet.
CONTROL_WIDTHS = np.stack([WIDTHS[(np.arange(256) >> s) & 3] for s in (0, 2, 4, 6)], axis=1)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data octets of ranks."""
    codes = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16)
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = codes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    octets = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), octets[np.arange(4) < WIDTHS[codes][:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks behind control and data octets."""
    widths = CONTROL_WIDTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(widths) - widths
    octets = np.frombuffer(data + b"\0\0\0", np.uint8)
    ranks = octets[starts].astype(np.uint32)
    for k in (1, 2, 3):
        wide = widths > k
        ranks[wide] |= octets[starts[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def id_frequencies(encoded: DataFrame, vocabulary: int, dtype: np.dtype) -> DataFrame:
    """id, n over the binary column ``ids``: each task sends one row for each id it met, ``vocabulary`` at most."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            every = b"".join(x.as_py() for x in batch.column(0))
            total += np.bincount(np.frombuffer(every, dtype), minlength=vocabulary)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["id", "n"])

    return encoded.select("ids").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text and write the token file to ``path``, ascending doc_id.

    Null and blank texts are written as the end id alone.  Rows with a null doc_id come
    first; rows of one doc_id stand in the order of their ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = max(vocabulary_size(tokenizer), end_id + 1)
    dtype = np.dtype("<u2") if vocabulary <= 1 << 16 else ID_TYPE
    # Written once, as ranks do not exist before all ids are counted.
    encoded = materialise(encoded_ids(rows, "text", tokenizer, end_id, dtype), "encoded", "zstd")
    counted = id_frequencies(encoded, vocabulary, dtype).collect()  # at most the vocabulary
    by_use = sorted(((r["n"], r["id"]) for r in counted), key=lambda x: (-x[0], x[1]))
    ids = [i for _, i in by_use]
    spark.createDataFrame(
        [(k, i, n) for k, (n, i) in enumerate(by_use)], "rank long, id long, n long"
    ).coalesce(1).write.parquet(f"{path}/ranks")
    to_rank = np.zeros(vocabulary, np.int64)
    to_rank[ids] = np.arange(len(ids))
    shared = spark.sparkContext.broadcast(to_rank)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        octets = 0

        def close() -> pa.RecordBatch:
            ranks = shared.value[np.frombuffer(b"".join(held), dtype)]
            control, data = pack(ranks)
            lengths = [len(x) // dtype.itemsize for x in held]
            values = [part, block, len(ranks), doc_ids, lengths, control, data]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, SCHEMA, strict=True)], schema=SCHEMA)

        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                held.append(x.as_py())
                octets += len(held[-1])
                if octets >= BLOCK_IDS * dtype.itemsize:
                    yield close()
                    doc_ids, held, octets, block = [], [], 0, block + 1
        if held:
            yield close()

    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(blocks, BLOCK_DDL).write.option("compression", "none").parquet(f"{path}/blocks")


SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("control", pa.binary()),
        ("data", pa.binary()),
    ]
)
BLOCK_DDL = "part int, block int, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a token file: doc_id, start, n_tokens, ids_crc32 (and the ids).

    ``start`` is the number of ids of all documents before it.  Partition totals (one
    row each) and the blocks of one partition are summed in windows of their own.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("part", "block", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("of_part"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sizes.withColumn("of_block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(parts, "part")
        .select("part", "block", (F.col("of_part") + F.col("of_block")).alias("first_token"))
    )
    ids = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()], ID_TYPE)  # at most the vocabulary
    shared = spark.sparkContext.broadcast(ids)
    names = ["part", "block", "doc_id", "offset", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_id = shared.value
        for batch in batches:
            for part, block, n, doc_ids, lengths, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = to_id[unpack(control, data, n)].tobytes()
                ends = np.cumsum(lengths)
                offsets = ends - lengths
                each = [own[4 * a : 4 * b] for a, b in zip(offsets.tolist(), ends.tolist(), strict=True)]
                made = [
                    pa.array([part] * len(each), pa.int32()),
                    pa.array([block] * len(each), pa.int32()),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(offsets, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([crc32(x) for x in each], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(made + ([pa.array(each, pa.binary())] if with_ids else []), names=names)

    ddl = "part int, block int, doc_id long, offset long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    docs = blocks.select("part", "block", "n_ids", "doc_ids", "lengths", "control", "data").mapInArrow(decode, ddl)
    return docs.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("first_token") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )


def token_file_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write a token file in the shared folder and read every document back from it."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer=tokenizer)
    return read_tokens(docs.sparkSession, path)
