"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are 64-bit majority votes over the XXH64 of word shingles.  Two
fingerprints that differ in at most ``max_bits`` bits agree on at least
``blocks - max_bits`` of ``blocks`` blocks, so every such pair meets under one of
the ``C(blocks, max_bits)`` keys made of that many whole blocks.  The distances
of all pairs that meet are verified inside Arrow batches, and only a spanning
forest of the links found there leaves the task: components stay exact and a
group of n close fingerprints yields n - 1 rows, not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .joins import split_join
from .storage import materialise
from .tables import free_names
from .tables import row_digest as all_columns

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
#: Larger groups are compared tile by tile, each pair of tiles in a task of its own.
TILE = 4096


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``width`` words; A-Z lower-cased, ASCII white space splits."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def simhash(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The fingerprint as an unsigned integer; 0 for a text without words."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 65536):  # keeps the bit matrix of a very long text small
        octets = hashes[part : part + 65536].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, digest: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and, if asked for, the text's SHA-256 (null for a null text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((simhash(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([text_digest(text_col).alias("digest")] if digest else []))
    return rows.mapInArrow(of, "doc_id long, fp long" + (", digest binary" if digest else ""))


def text_digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.col(text_col), 256))


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Bit masks of every choice of ``blocks - max_bits`` blocks, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    whole = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(whole[i] for i in chosen) for chosen in combinations(range(blocks), blocks - max_bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def blocks_for(n_fingerprints: int, max_bits: int) -> int:
    """Fewest blocks whose keys are at least a quarter as many as the fingerprints; exact at any value."""
    blocks = max_bits + 2
    while blocks < 2 * max_bits + 2 and 4 << (64 * (blocks - max_bits) // blocks) < n_fingerprints:
        blocks += 1
    return blocks


def forest(values: np.ndarray, others: np.ndarray | None, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``values``, or between ``values`` and ``others``.

    Each round takes one node that no one has claimed and claims all that link to what
    was claimed before it, so each node is compared with all the rest once.
    """
    nodes = values if others is None else np.concatenate((values, others))
    free = np.ones(len(nodes), bool)
    found: list[tuple[int, int]] = []
    for start in range(len(values)):
        if not free[start]:
            continue
        free[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            if others is None:
                rest = np.flatnonzero(free)
            elif at < len(values):
                rest = np.flatnonzero(free[len(values) :]) + len(values)
            else:
                rest = np.flatnonzero(free[: len(values)])
            if not len(rest):
                continue
            close = rest[np.bitwise_count(nodes[rest] ^ nodes[at]) <= max_bits]
            free[close] = False
            todo.extend(close.tolist())
            found.extend((int(nodes[at]), int(nodes[x])) for x in close)
    return found


def _verify(max_bits: int):
    """mapInArrow over (mask_no, key, fp, side) rows sorted by group: links as (a, b)."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None

        def of(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            group = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            bounds = np.concatenate(([0], group, [len(cols[0])]))
            sizes = np.diff(bounds)
            fp, side = cols[3].view(np.uint64), cols[4]
            pairs = []
            two = bounds[:-1][(sizes == 2) & (side[bounds[:-1]] == side[bounds[1:] - 1])]
            close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
            pairs += zip(fp[close].view(np.int64).tolist(), fp[close + 1].view(np.int64).tolist(), strict=True)
            done = set(two.tolist())
            for k in np.flatnonzero(sizes >= 2).tolist():
                a, b = int(bounds[k]), int(bounds[k + 1])
                if a in done:
                    continue
                left, right = fp[a:b][side[a:b] == 0], fp[a:b][side[a:b] == 1]
                for x, y in forest(left, right if len(right) else None, max_bits):
                    pairs.append((int(np.uint64(x).view(np.int64)), int(np.uint64(y).view(np.int64))))
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            same = np.all([c == c[-1] for c in cols[:3]], axis=0)
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            carry = [c[last:] for c in cols]
            if last:
                yield from of([c[:last] for c in cols])
        if carry is not None:
            yield from of(carry)

    return edges


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """a, b: links between the distinct fingerprints of ``fps`` (column fp), enough to span every component."""
    blocks = blocks or blocks_for(fps.count(), max_bits)
    if comb(blocks, max_bits) > 1000:
        raise ValueError(f"{blocks} blocks for {max_bits} bits make too many keys")
    masks = F.array(*(F.lit(m).cast("long") for m in block_masks(blocks, max_bits)))
    keyed = fps.select("fp", F.posexplode(masks).alias("mask_no", "mask")).select("mask_no", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    # Counted by partial sums and joined back, so that a key of very many fingerprints is never one task.
    counts = materialise(keyed.groupBy("mask_no", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("n_rows", F.col("n")), "simhash-keys")
    met = split_join(keyed, counts, ["mask_no", "key"], "n_rows", ["fp"], counts.count())
    order = ["mask_no", "key", "tile", "fp", "side"]
    usual = met.filter(F.col("n") <= tile).select("mask_no", "key", F.lit(0).alias("tile"), "fp", F.lit(0).alias("side"))
    usual = usual.repartition("mask_no", "key").sortWithinPartitions("mask_no", "key")
    # Large groups: deal the fingerprints into t tiles; each pair of tiles is a group of its own.
    dealt = met.filter(F.col("n") > tile).withColumn("t", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("t")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    large = (
        spread.select("mask_no", "key", (low * F.col("t") + high).alias("tile"), "fp", (F.col("own") > F.col("other")).cast("int").alias("side"))
        .repartition("mask_no", "key", "tile")
        .sortWithinPartitions("mask_no", "key", "tile")
    )
    verify = _verify(max_bits)
    found = usual.select(order).mapInArrow(verify, "a long, b long").unionByName(large.select(order).mapInArrow(verify, "a long, b long"))
    return found.distinct()


def with_least(nodes: DataFrame, first: str, max_bits: int, blocks: int | None = None) -> DataFrame:
    """``nodes`` (one row for each fingerprint ``fp``) with ``first`` replaced by its least value in the component."""
    linked = materialise(connected_components(links(nodes.select("fp"), max_bits, blocks)), "simhash-linked")
    own = linked.join(nodes, linked["node"] == nodes["fp"])
    least = own.groupBy("component").agg(F.min(first).alias("least"), F.count(F.lit(1)).alias("n_nodes"))
    least = materialise(least, "simhash-components")
    named = split_join(linked, least, ["component"], "n_nodes", ["node"], least.count()).select("node", F.struct("least").alias("least"))
    joined = nodes.join(named, nodes["fp"] == named["node"], "left")
    value = F.when(F.col("least").isNotNull(), F.col("least.least")).otherwise(F.col(first))
    return joined.select(*(value.alias(first) if c == first else c for c in nodes.columns))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, blocks: int | None = None
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    A null text counts as empty; texts without words have fingerprint 0 and link like
    any other.  Fewer words than a shingle: the whole sequence is the only shingle.
    Documents with equal fingerprints are one node, whatever their number.  A document
    without doc_id links like any other and gets its component's smallest doc_id (null
    if none has one); ids are numbers, or text that casts to them.  Repeated rows come out as often as they came.  An empty table
    gives an empty result.  Other columns are not looked at.
    """
    marked = materialise(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n_docs")), "simhash-nodes")
    named = materialise(with_least(nodes, "component_id", max_bits, blocks), "simhash-named")
    joined = split_join(marked, named, ["fp"], "n_docs", ["doc_id"], nodes.count())
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest doc_id.

    Rows are told apart by doc_id and text, so different texts may share a doc_id or have
    none.  A row without doc_id stays only where no row of its component has one; among
    rows of one doc_id and component the least digest of the text decides, and of rows
    equal in both that of the least digest of all columns remains.  Null and empty texts have fingerprint 0; very long texts
    are read whole; an empty table stays empty; extra columns may have any names.
    """
    marked = materialise(fingerprints(docs, id_col, text_col, width, digest=True), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest"))
    nodes = materialise(marked.groupBy("fp").agg(first.alias("first_row")), "simhash-nodes")
    least = with_least(nodes, "first_row", max_bits).select("first_row").distinct()
    kept = materialise(least.select(F.col("first_row.doc_id").alias("_keep_id"), F.col("first_row.digest").alias("_keep_digest")), "simhash-kept")
    row_id, row_digest, whole = free_names(docs, "row_id", "row_digest", "row")
    rows = docs.withColumns({row_id: F.col(id_col).cast("long"), row_digest: text_digest(text_col)})
    if not marked.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():
        # Taken together before the join, and on the map side, so that copies are not one task.
        rows = rows.groupBy(row_id, row_digest).agg(F.min_by(F.struct(*docs.columns), all_columns(docs)).alias(whole)).select(row_id, row_digest, f"{whole}.*")
    same = rows[row_id].eqNullSafe(kept["_keep_id"]) & rows[row_digest].eqNullSafe(kept["_keep_digest"])
    return rows.join(kept, same, "left_semi").select(*docs.columns)
