"""Canonical exact digests.

Texts are brought to one form (compatibility composition, full case folding, white
space runs to one space, trimmed) and digested by two xxhash64 lanes of different
seeds, 128 bits together.  Equal digests are only candidates: where a bucket has more
than one text, the canonical octets are compared, and if they differ the digest gets a
number for each of its texts, so equal fingerprints of documents mean equal canonical texts.

DataFrame and SQL functions only; Unicode comes from the ICU classes that Spark ships,
through ``reflect``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

NORMALIZER = "com.ibm.icu.text.Normalizer"
CHARACTERS = "com.ibm.icu.lang.UCharacter"
LANES = (0x1F3D5B79, 0x2E4C6A88)


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again (folding can undo it), white space folded and trimmed; null is empty."""

    def composed(x: Column) -> Column:
        return F.reflect(F.lit(NORMALIZER), F.lit("compose"), x, F.lit(True))

    folded = F.reflect(F.lit(CHARACTERS), F.lit("foldCase"), composed(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), r"[\s\x0B\x85\p{Z}]+", " "))


def lanes(form: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), form) for seed in LANES]


def hex_digest(high: Column, low: Column, variant: Column | None = None) -> Column:
    digest = F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))
    return digest if variant is None else F.concat(digest, F.when(variant > 0, F.concat(F.lit("-"), variant.cast("string"))).otherwise(F.lit("")))


#: Shared digests, and ids behind them, that are broadcast at most; beyond that they are joined by shuffling.
BROADCAST_IDS = 2_000_000


def variants(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """high, low, form, variant for every text whose digest another canonical text has too (normally none).

    ``rows`` has doc_id and text, ``narrow`` doc_id, high and low.  Digests that occur once
    can't clash, so only the texts behind the others are read again.  The least and greatest
    form of each digest are found by partial aggregation, so a digest with very many copies
    sends two forms from each task.  Where they differ the bucket's distinct forms are
    numbered, again after each task has reduced them to one row a form.
    """
    shared = materialise(narrow.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("high", "low"), "shared")
    # Matched on the map side, or by a join whose large partitions can be split: a digest may be that of very many rows.
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared
    again = materialise(narrow.join(shared, ["high", "low"], "left_semi").select(F.col("doc_id").alias("again_id")).distinct(), "shared-digests")
    again = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    formed = rows.join(again, rows["doc_id"].eqNullSafe(again["again_id"]), "left_semi").select(canonical(F.col("text")).alias("form"))
    high, low = lanes(F.col("form"))
    formed = formed.select(high.alias("high"), low.alias("low"), "form")
    clash = formed.groupBy("high", "low").agg(F.min("form").alias("least"), F.max("form").alias("most")).filter("least <> most").select("high", "low")
    clash = materialise(clash, "clash")
    if clash.isEmpty():
        return clash.withColumns({"form": F.lit("").cast("string"), "variant": F.lit(0)})
    distinct = formed.groupBy("high", "low", "form").agg(F.count(F.lit(1)).alias("n")).join(clash, ["high", "low"], "left_semi")
    order = Window.partitionBy("high", "low").orderBy("form")
    return materialise(distinct.select("high", "low", "form", (F.row_number().over(order) - 1).alias("variant")), "variants")


def digest_rows(rows: DataFrame) -> DataFrame:
    """doc_id, n_chars, high, low for rows of doc_id and text, written once."""
    formed = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), canonical(F.col("text")).alias("form"))
    high, low = lanes(F.col("form"))
    return materialise(formed.select("doc_id", "n_chars", high.alias("high"), low.alias("low")), "fingerprints")


def _numbered(keyed: DataFrame, clashes: DataFrame, form: Column, high: Column, low: Column, name: str) -> DataFrame:
    """``keyed`` with the text fingerprint ``name``: digest, and the number of its form where digests clash."""
    if clashes.isEmpty():
        return keyed.withColumn(name, hex_digest(high, low))
    own = clashes.select(F.col("high").alias("_h"), F.col("low").alias("_l"), F.col("form").alias("_f"), F.col("variant").alias("_v"))
    formed = keyed.withColumn("_form", form)  # a column first: reflected functions may not stand in a join's condition
    joined = formed.join(own, (high == own["_h"]) & (low == own["_l"]) & (F.col("_form") == own["_f"]), "left")
    return joined.withColumn(name, hex_digest(high, low, F.coalesce("_v", F.lit(0)))).drop("_h", "_l", "_f", "_v", "_form")


def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, group_size: one row per row of ``docs``.

    Equal canonical texts have equal fingerprints and no others have.  Null counts as
    empty; null ids and repeated rows are rows like any other; an empty table gives an
    empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    narrow = digest_rows(rows)
    clashes = variants(rows, narrow)
    if clashes.isEmpty():
        named = narrow.select("doc_id", hex_digest(F.col("high"), F.col("low")).alias("fingerprint"))
    else:
        formed = rows.select("doc_id", canonical(F.col("text")).alias("form"))
        named = _numbered(formed, clashes, F.col("form"), *lanes(F.col("form")), "fingerprint").select("doc_id", "fingerprint")
    sizes = named.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("group_size"))
    return named.join(sizes, "fingerprint").select("doc_id", "fingerprint", "group_size")


def _key(name: str) -> Column:
    """An id as text that is never null and tells a null id from an empty one."""
    return F.coalesce(F.concat(F.lit("i"), F.col(name).cast("string")), F.lit("n"))


#: Ids with more than this part of all rows are dealt into several parts; no more than this many ids can be.
HOT_IDS = 1000


def _deal(rows: DataFrame, heads: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns ``salt`` for both: rows of an id that very many rows share are dealt by their texts, and its head goes to each part."""
    total = sizes.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    often = F.broadcast(sizes.filter(F.col("n_rows") * HOT_IDS > total).select(F.col("key").alias("often"), F.ceil(F.col("n_rows") * HOT_IDS / F.lit(total)).cast("int").alias("n_parts")))
    n_parts = F.coalesce("n_parts", F.lit(1))
    dealt = rows.join(often, F.col("key") == F.col("often"), "left").withColumn("salt", F.pmod(F.xxhash64("text"), n_parts).cast("int")).drop("often", "n_parts")
    shown = heads.join(often, F.col("asker") == F.col("often"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n_parts - 1))).drop("often", "n_parts")
    return dealt, shown


def next_ids(ids: DataFrame) -> DataFrame:
    """doc_id, next_id for distinct ids: the next in descending order, the first after the last; null stands last.

    Ids are dealt into ranges; each range is ordered by itself, and its first row takes
    its neighbour from the bounds of the ranges (one row each).
    """
    ranged = materialise(ids.repartitionByRange(F.desc_nulls_last("doc_id")).withColumn("part", F.spark_partition_id()), "ranges")
    order = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"))
    linked = ranged.select("doc_id", "part", F.lead(F.struct("doc_id")).over(order).alias("next"), F.row_number().over(order).alias("place"))
    firsts = linked.filter("place = 1").select(F.col("part").alias("first_part"), F.col("doc_id").alias("first_id"))
    parts = Window.orderBy("first_part")
    whole = Window.orderBy("first_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(F.col("first_part").alias("part"), F.coalesce(F.lead(F.struct("first_id")).over(parts), F.first(F.struct("first_id")).over(whole)).alias("after"))
    joined = linked.join(F.broadcast(after), "part")
    return joined.select("doc_id", F.when(F.col("next").isNull(), F.col("after.first_id")).otherwise(F.col("next.doc_id")).alias("next_id"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document's text, in descending doc_id; after the last comes the first.
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next: likeness is 1 for equal fingerprints, else 0, as the digest is exact.

    Null texts are empty; a null doc_id stands last.  Rows repeated with one doc_id each
    come out; as somebody's next document, such an id stands for its smallest text.  A
    single document is its own next.  An empty table gives an empty result.  Clashes are
    sought among the documents' own texts; an edited text that shared its digest with
    some document of another form, but no two documents did, would go unnoticed, save
    that ``near_edited`` compares it with its own original.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    narrow = digest_rows(rows)
    clashes = variants(rows, narrow)
    by_id = narrow.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"), F.first("high").alias("high"), F.first("low").alias("low"), F.count(F.lit(1)).alias("n_rows"))
    steps = materialise(next_ids(by_id.select("doc_id")), "next-ids")
    unique = narrow.count() == steps.count()
    # What each document must show of itself, its head, and to which document.  Keys are never
    # null, and both joins read the same columns, so that the texts are dealt once.
    by_key = by_id.select(_key("doc_id").alias("key"), "n_chars", "high", "low")
    own, after = by_key.alias("own"), by_key.alias("after")
    asked = (
        steps.select("doc_id", _key("doc_id").alias("asker"), _key("next_id").alias("shower"))
        .join(own, F.col("asker") == F.col("own.key"))
        .join(after, F.col("shower") == F.col("after.key"))
        .select(
            "doc_id",
            "asker",
            "shower",
            F.floor(F.col("own.n_chars") / 2).cast("int").alias("asked"),
            *(F.col(f"{side}.{lane}").alias(f"{side}_{lane}") for side in ("own", "after") for lane in ("high", "low")),
        )
    )
    dealt = rows.select(_key("doc_id").alias("key"), "text")
    if unique:
        dealt = dealt.repartition("key")
        shown = dealt
    else:
        shown = dealt.groupBy("key").agg(F.min("text").alias("text"))
    heads = shown.join(asked, F.col("key") == F.col("shower"))
    if not unique:
        high, low = lanes(canonical(F.col("text")))
        heads = heads.withColumn("after_high", high).withColumn("after_low", low)
    heads = _numbered(heads, clashes, canonical(F.col("text")), F.col("after_high"), F.col("after_low"), "after_fingerprint")
    heads = heads.select("doc_id", "asker", F.expr("substring(text, 1, asked)").alias("head"), "own_high", "own_low", "after_fingerprint")
    if unique:
        whole = dealt.join(heads, F.col("key") == F.col("asker"))
    else:
        sizes = by_id.select(_key("doc_id").alias("key"), "n_rows")
        dealt, heads = _deal(dealt, heads, sizes)
        whole = dealt.join(heads, (F.col("key") == F.col("asker")) & (dealt["salt"] == heads["salt"])).drop("salt")
    if not unique:
        high, low = lanes(canonical(F.col("text")))
        half = F.expr("substring(head, 1, cast(floor(length(text) / 2) as int))")
        whole = whole.withColumn("own_high", high).withColumn("own_low", low).withColumn("head", half)
    edited = whole.withColumn(
        "edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.col("head"))
    ).withColumn("edited_form", canonical(F.col("edited")))
    e_high, e_low = lanes(F.col("edited_form"))
    edited = edited.withColumn("e_high", e_high).withColumn("e_low", e_low)
    text_form = canonical(F.col("text"))
    edited = _numbered(edited, clashes, text_form, F.col("own_high"), F.col("own_low"), "fingerprint")
    edited = _numbered(edited, clashes, F.col("edited_form"), F.col("e_high"), F.col("e_low"), "edited_fingerprint")
    same_digest = (F.col("own_high") == F.col("e_high")) & (F.col("own_low") == F.col("e_low"))
    return edited.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        F.when(same_digest, text_form == F.col("edited_form")).otherwise(F.lit(False)).cast("double").alias("near_edited"),
        (F.col("fingerprint") == F.col("after_fingerprint")).cast("double").alias("near_next"),
    )
