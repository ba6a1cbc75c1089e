"""Alignment of two tokenizers over the same octets.

A text with a space before it is encoded by a byte-level vocabulary (A) and by a
sentence-piece vocabulary (B).  In Arrow: lists of ids are flattened, parent indices say
which document an id belongs to, segmented cumulative sums of the tokens' octets give
where each ends, and an Acero hash join on (document, end) finds where both end.  Those
places cut the tokens into groups.  Within groups, tokens whose octets overlap are
linked.  How many documents hold a pair of ids linked is counted by ``Table.group_by``
in the tasks, and the partial counts are merged by Spark.

Links are written once, as counts don't exist before every document has been aligned;
the tables that pass through shuffles have a row for each pair of ids, not for each link.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_automaton import read_merges
from .byte_bpe import ID_TYPE, SINGLE_SPACE, TWO_BLANKS, Remembered, TextEncoder, default_tokenizer, lists
from .encoding import octet_letters
from .storage import materialise
from .tables import free_names

BLANK = "▁"
#: Code points that are aligned at once; a longer text is aligned by itself.
SLICE_POINTS = 400_000
#: Pairs of ids whose counts are broadcast at most; others are joined by shuffling.
BROADCAST_PAIRS = 2_000_000
#: Rows of partial counts that a task holds before it reduces them, and before it hands them on.
REDUCE_ROWS, HELD_ROWS = 500_000, 1_000_000
#: Bits that the end of a token in its document takes in a key; above it is the document.
END_BITS = pa.scalar(40, pa.int64())
#: An id that marks a chunk whose pieces don't spell it.
UNLIKE = -1
MARK = array("i", [UNLIKE]).tobytes()


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def parts(text: str) -> list[str]:
    """What follows each place where a text with a space before it can be cut without cutting a token of A or B.

    That is at single spaces between other characters: A's words and B's pieces have
    spaces at their start only.
    """
    spaced = " " + text
    if TWO_BLANKS.search(spaced) is None:
        return spaced.split(" ")[1:]
    first, *rest = SINGLE_SPACE.split(spaced)
    return [first[1:], *rest]


class LibraryMerges:
    """What ``TextEncoder`` asks for words, by the library's own merges; special tokens are plain text here."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        told = read_merges(path)
        self.labels = [told.labels.get(i, b"") for i in range(max(told.labels) + 1)]
        self.special: dict[str, int] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.letters = self.tokenizer.model.tokenize, octet_letters()

    def path(self, word: bytes) -> list[int]:
        return [t.id for t in self.tokenize(word.decode("latin-1").translate(self.letters))]


class PieceEncoder:
    """Ids of B for texts and chunks, and the octets of each piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        spelt = [self.model.id_to_piece(i) for i in range(n)]
        self.labels = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(spelt)
        ]
        if any(BLANK in p.lstrip(BLANK) for i, p in enumerate(spelt) if not self.model.is_byte(i)):
            raise ValueError(f"{path} has pieces with a space inside, so texts can't be cut at spaces")
        self.blank = self.model.piece_to_id(BLANK)
        self.sizes = np.array([len(x) for x in self.labels])

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks with a space before each; ``UNLIKE`` behind those that spell something else."""
        found = [ids or [self.blank] for ids in self.model.encode(chunks, num_threads=1)] if chunks else []
        spelt = b"".join([self.labels[i] for ids in found for i in ids])
        wanted = [(" " + c).encode() for c in chunks]
        if spelt != b"".join(wanted) or not np.array_equal(self.octets_of(found), [len(w) for w in wanted]):
            found = [ids if b"".join(map(self.labels.__getitem__, ids)) == w else [*ids, UNLIKE] for ids, w in zip(found, wanted, strict=True)]
        return [array("i", ids).tobytes() for ids in found]

    def octets_of(self, found: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((i for ids in found for i in ids), np.int64)
        return sums_by(self.sizes[flat], np.cumsum([len(ids) for ids in found], dtype=np.int64))

    def joined(self, text: str, octets: list[bytes]) -> bytes:
        """Ids of a text from those of its chunks; none if they don't spell the text with a space before it."""
        found = b"".join(octets)
        if MARK in found:
            ids = np.frombuffer(found, ID_TYPE)
            ids = ids[ids != UNLIKE]
            found = ids.tobytes() if b"".join(map(self.labels.__getitem__, ids.tolist())) == (" " + text).encode() else b""
        return found


def sums_by(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the parts of ``values`` that end at ``ends``, empty ones too."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[np.concatenate(([0], ends))]
    return np.diff(total)


@dataclass(frozen=True)
class Side:
    """The tokens of some documents by one tokenizer."""

    ids: pa.ListArray
    octets: pa.Array

    @cached_property
    def flat(self) -> pa.Array:
        return pc.list_flatten(self.ids)

    @cached_property
    def doc(self) -> pa.Array:
        return pc.cast(pc.list_parent_indices(self.ids), pa.int32())

    @cached_property
    def doc_ends(self) -> np.ndarray:
        return self.ids.offsets.to_numpy()[1:].astype(np.int64)

    @cached_property
    def total(self) -> np.ndarray:
        """Octets up to the end of each token, those of earlier documents too."""
        return pc.cumulative_sum(pc.cast(pc.take(self.octets, self.flat), pa.int64())).to_numpy()

    @cached_property
    def ends(self) -> pa.Array:
        """Where each token ends in its document: the cumulative sum less what came before the document."""
        before = np.concatenate(([0], self.total))[np.concatenate(([0], self.doc_ends[:-1]))] if len(self.doc_ends) else np.zeros(0, np.int64)
        return pc.subtract(pa.array(self.total), pc.take(pa.array(before), self.doc))


    @cached_property
    def doc_end(self) -> pa.Array:
        """Document and end as one key."""
        return pc.bit_wise_or(pc.shift_left(pc.cast(self.doc, pa.int64()), END_BITS), self.ends)


class Aligned:
    """Documents aligned; ``a`` and ``b`` have the same octets in each."""

    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b = a, b
        left = pa.table({"key": a.doc_end, "a_at": np.arange(len(a.flat), dtype=np.int32)})
        right = pa.table({"key": b.doc_end, "b_at": np.arange(len(b.flat), dtype=np.int32)})
        both = left.join(right, keys="key", join_type="inner", use_threads=False)
        #: Whether a token ends where one of the other side ends.
        self.a_closes, self.b_closes = np.zeros(len(a.flat), bool), np.zeros(len(b.flat), bool)
        self.a_closes[both["a_at"].to_numpy()] = True
        self.b_closes[both["b_at"].to_numpy()] = True

    @cached_property
    def a_group(self) -> np.ndarray:
        return np.cumsum(self.a_closes) - self.a_closes

    @cached_property
    def b_group(self) -> np.ndarray:
        return np.cumsum(self.b_closes) - self.b_closes

    @cached_property
    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the linked tokens of A and of B, and where each document's links end.

        Between two neighbouring ends, of A or B, lies octets of one token of each, and
        every overlap of two tokens is one such stretch.
        """
        inner = np.flatnonzero(~self.b_closes)
        stretches = 1 + np.bincount(np.searchsorted(self.a.total, self.b.total[inner]), minlength=len(self.a.flat))
        a_at = np.repeat(np.arange(len(self.a.flat)), stretches)
        last = np.cumsum(stretches) - 1
        ends_b = np.ones(len(a_at), bool)
        ends_b[last] = self.a_closes
        return a_at, np.cumsum(ends_b) - ends_b, np.concatenate(([0], last + 1))[self.a.doc_ends]

    def pairs(self, size_b: int) -> np.ndarray:
        """A code of both ids for each link."""
        a_at, b_at, _ = self.links
        return self.a.flat.to_numpy()[a_at].astype(np.int64) * size_b + self.b.flat.to_numpy()[b_at]

    def spelt(self, decimals: pa.Array) -> tuple[memoryview, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` of all documents in a row, and where each document ends in it."""
        a_groups_end = np.flatnonzero(self.a_closes) + 1
        b_groups_start = np.concatenate(([0], np.flatnonzero(self.b_closes) + 1))
        code = np.empty(len(self.a.flat) + len(self.b.flat), np.int64)
        code[np.arange(len(self.a.flat)) + b_groups_start[self.a_group]] = self.a.flat.to_numpy().astype(np.int64) * 3 + self.a_closes
        code[np.arange(len(self.b.flat)) + a_groups_end[self.b_group]] = self.b.flat.to_numpy().astype(np.int64) * 3 + 2 * self.b_closes
        told = pc.take(decimals, pa.array(code))
        _, offsets, octets = told.buffers()
        places = np.frombuffer(offsets, np.int64)[: len(code) + 1]
        return memoryview(octets or b""), places[self.a.doc_ends + self.b.doc_ends]


class Aligner:
    """Both encoders and what alignment needs of their vocabularies."""

    def __init__(self, a_path: str, pieces: str) -> None:
        merges = LibraryMerges(a_path)
        self.a, self.b = TextEncoder(merges), PieceEncoder(pieces)
        self.a_octets, self.b_octets = (pa.array([len(x) for x in labels], pa.int32()) for labels in (merges.labels, self.b.labels))
        most = max(len(self.a_octets), len(self.b_octets))
        #: Each number with a comma, a stroke and a semicolon.
        self.decimals = pa.array([f"{i}{mark}" for i in range(most) for mark in ",|;"], pa.large_string())

        self.table = Remembered(lambda chunk: self.both([chunk])[0])

    def both(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of A and B for chunks with a space before each."""
        return list(zip(map(self.a.after_space, chunks), self.b.ids_of(chunks), strict=True))

    def align(self, texts: list[str | None]) -> Aligned:
        a_ids, b_ids = [], []
        every = [parts(text) if text else [] for text in texts]
        self.table.fill(chain.from_iterable(every), self.both)
        for text, cut in zip(texts, every, strict=True):
            a = b = b""
            if text:
                of_a, of_b = zip(*map(self.table.__getitem__, cut), strict=True)
                b = self.b.joined(text, of_b)
                a = b"".join(of_a) if b else b""
            a_ids.append(a)
            b_ids.append(b)
        return Aligned(Side(lists(a_ids), self.a_octets), Side(lists(b_ids), self.b_octets))


def slices(texts: pa.Array, points: int = SLICE_POINTS) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch, a few at a time: place of the first, and the texts."""
    start, held, n = 0, [], 0
    for k, x in enumerate(texts):
        text = x.as_py()
        if held and n + len(text or "") > points:
            yield start, held
            start, held, n = k, [], 0
        held.append(text)
        n += len(text or "")
    if held:
        yield start, held


_own: list = [None, None, None]


def aligner(a_path: str, pieces: str) -> Aligner:
    """The aligner of this worker process."""
    if _own[:2] != [a_path, pieces]:
        _own[:] = a_path, pieces, Aligner(a_path, pieces)
    return _own[2]


def align(docs: DataFrame, text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``docs`` with all its columns and a_ids, b_ids (``array<int>``) and groups.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``: ids of A and B between places where both end.
    A text that is null or empty, or that B's pieces don't spell, has no ids and no groups.
    The new names get underscores where they are taken.
    """
    a_path, pieces = a_path or default_tokenizer(), b_path or default_pieces()
    names = free_names(docs, "a_ids", "b_ids", "groups")
    ids = T.ArrayType(T.IntegerType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (ids, ids, T.StringType()), strict=True))])
    at = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, pieces)
        for batch in batches:
            for start, texts in slices(batch.column(at)):
                found = own.align(texts)
                octets, ends = found.spelt(own.decimals)
                starts = np.concatenate(([0], ends[:-1]))
                told = [bytes(octets[a : max(a, b - 1)]).decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns, found.a.ids, found.b.ids, pa.array(told, pa.string())], names=schema.fieldNames())

    return docs.mapInArrow(of, schema)


def aligned_links(docs: DataFrame, id_col: str, text_col: str, a_path: str, pieces: str, code_type: np.dtype) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the links' pairs as octets; ``row`` numbers the rows."""
    rows = docs.select(text_col, id_col)
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", rows.schema[1].dataType),
            *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")),
            T.StructField("groups_sha256", T.StringType()),
            T.StructField("pairs", T.BinaryType()),
        ]
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, row = aligner(a_path, pieces), TaskContext.get().partitionId() << 33
        for batch in batches:
            for start, texts in slices(batch.column(0)):
                found = own.align(texts)
                octets, ends = found.spelt(own.decimals)
                *_, links_end = found.links
                codes = found.pairs(len(own.b_octets)).astype(code_type).tobytes()
                starts, link_starts = np.concatenate(([0], ends[:-1])), np.concatenate(([0], links_end[:-1]))
                size = code_type.itemsize
                digests = [sha256(octets[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                pairs = [codes[size * a : size * b] for a, b in zip(link_starts.tolist(), links_end.tolist(), strict=True)]
                n_a, n_b = (np.diff(side.doc_ends, prepend=0) for side in (found.a, found.b))
                counts = (n_a, n_b, sums_by(found.a_closes, found.a.doc_ends), links_end - link_starts)
                made = [pa.array(np.arange(row, row + len(texts))), batch.column(1).slice(start, len(texts)), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(pairs, pa.binary())]
                row += len(texts)
                yield pa.RecordBatch.from_arrays(made, names=schema.fieldNames())

    return rows.mapInArrow(of, schema)


def flat_codes(column: pa.Array, code_type: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a binary column, and where each row ends."""
    ends = np.cumsum([len(x) // code_type.itemsize for x in column.to_pylist()], dtype=np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), code_type), ends


def pair_counts(links: DataFrame, code_type: np.dtype) -> DataFrame:
    """pair, n: documents that hold a pair linked.  Partial counts of the tasks, merged by Spark."""

    def reduced(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                codes, ends = flat_codes(batch.column(0).slice(k, 500), code_type)
                doc = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
                once = pa.table({"doc": doc, "pair": codes}).group_by(["doc", "pair"], use_threads=False).aggregate([])
                held.append(once.append_column("n", pa.array(np.ones(once.num_rows, np.int64))).select(["pair", "n"]))
                if sum(t.num_rows for t in held) > REDUCE_ROWS + held[0].num_rows:
                    held = [reduced(held)]
                    if held[0].num_rows > HELD_ROWS:
                        yield from as_longs(held.pop()).to_batches()
        if held:
            yield from as_longs(reduced(held)).to_batches()

    def as_longs(t: pa.Table) -> pa.Table:
        return pa.table({"pair": pc.cast(t["pair"], pa.int64()), "n": t["n"]})

    return links.select("pairs").mapInArrow(of, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, most: int = BROADCAST_PAIRS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of rows, corpus-wide, that hold it linked; ``n_best`` are
    the links whose count is the highest of their A id, ties included; ``count_sum`` sums
    over links.  A text that is null or empty, or that B's pieces don't spell, has zeros and
    an empty digest.  Rows of one doc_id count each.  Other columns are not looked at; an
    empty table gives an empty result.  If there are more than ``most`` pairs, those that
    more than a ``most``-th of all counted rows hold are broadcast (so no more of them
    than that), and the links of the others are joined by shuffling.
    """
    a_path, pieces = a_path or default_tokenizer(), b_path or default_pieces()
    size_a, size_b = (len(x.labels) for x in (LibraryMerges(a_path), PieceEncoder(pieces)))
    code_type = np.dtype("<i4") if size_a * size_b < 1 << 31 else np.dtype("<i8")
    links = materialise(aligned_links(docs, id_col, text_col, a_path, pieces, code_type), "links", "zstd")
    counts = materialise(pair_counts(links, code_type), "pairs")
    best = counts.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("n").alias("most"))
    judged = counts.join(best, F.expr(f"pair div {size_b}") == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
    n_pairs, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = F.lit(True) if n_pairs <= most else F.col("n") * F.lit(most) > F.lit(total)
    hot = pa.concat_tables([judged.filter(often).toArrow()]).sort_by("pair")  # ``most`` rows at most
    known = docs.sparkSession.sparkContext.broadcast((hot["pair"].to_numpy(), hot["n"].to_numpy(), hot["is_best"].to_numpy().astype(np.int64)))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = T.StructType([*(links.schema[c] for c in kept), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def looked_up(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each code its place among its distinct ones, these, and their place among the known (-1: not known)."""
        told = pc.dictionary_encode(pa.array(codes))
        own = told.dictionary.to_numpy()
        keys = known.value[0]
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        return told.indices.to_numpy(), own, np.where(keys[at] == own, at, -1) if len(keys) else np.full(len(own), -1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, is_best = known.value
        n, is_best = np.append(n, 0), np.append(is_best, 0)  # place -1: nothing
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                codes, ends = flat_codes(part.column(0), code_type)
                which, _, at = looked_up(codes)
                made = [pa.array(sums_by(values[at][which], ends)) for values in (is_best, n)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=schema.fieldNames())

    found = links.select("pairs", *kept).mapInArrow(score, schema)
    if n_pairs > most:

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 500):
                    codes, ends = flat_codes(batch.column(0).slice(k, 500), code_type)
                    which, own, at = looked_up(codes)
                    row = np.repeat(np.asarray(batch.column(1).slice(k, 500)), np.diff(ends, prepend=0))
                    left = (at < 0)[which]
                    t = pa.table({"row": row[left], "pair": own[which[left]].astype(np.int64)}).group_by(["row", "pair"], use_threads=False).aggregate([([], "count_all")])
                    yield from t.rename_columns(["row", "pair", "k"]).to_batches()

        rest = links.select("pairs", "row").mapInArrow(rare, "row long, pair long, k long").join(judged.filter(~often), "pair")
        more = rest.groupBy("row").agg(F.sum(F.col("k") * F.col("n")).alias("more_sum"), F.sum(F.col("k") * F.col("is_best").cast("long")).alias("more_best"))
        found = found.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
