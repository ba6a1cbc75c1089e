"""Free-text answers to canonical values.

NULL stands for "no readable value" everywhere; NaN is never produced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words that are read as values (fixed values).
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "none": 0, "no": 0,
}

#: Answers that name no class (fixed values).
NONE_PHRASES = ("none", "no foreign objects", "nothing")


def _nonempty(found: Column) -> Column:
    return F.nullif(found, F.lit(""))


def stripped(text: Column) -> Column:
    """Without white space at both ends; NULL is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def parse_number(text: Column) -> Column:
    """The first run of digits, else the first whole number word, as double."""
    digits = _nonempty(F.regexp_extract(text, r"(\d+)", 1)).cast("double")
    word = _nonempty(F.regexp_extract(F.lower(text), r"\b(" + "|".join(NUMBER_WORDS) + r")\b", 1))
    values = F.create_map(*(x for w, v in NUMBER_WORDS.items() for x in (F.lit(w), F.lit(float(v)))))
    return F.coalesce(digits, F.element_at(values, word))


def read_count(text: Column) -> Column:
    """The integer at the start, as double."""
    return _nonempty(F.regexp_extract(text, r"^\s*(\d+)", 1)).cast("double")


def normalise_answer(text: Column) -> Column:
    """Trims, and takes a stray final period (blanks may stand before it) off integers, yes/no (then lower-cased) and lists of clock times.

    Everything else, yes and no without a period too, stays as it is; NULL is empty.
    """
    bare = stripped(text)
    cut = F.regexp_replace(bare, r"\s*\.$", "")
    clock = r"^\d{1,2}:\d{2}:\d{2}(\s*,\s*\d{1,2}:\d{2}:\d{2})*\s*\.$"
    return F.when(bare.rlike(r"^\d+\s*\.$") | bare.rlike(clock), cut).when(bare.rlike(r"(?i)^(yes|no)\s*\.$"), F.lower(cut)).otherwise(bare)


def key_binary(text: Column) -> Column:
    """yes or no from a leading yes/no/true/false token."""
    token = _nonempty(F.regexp_extract(F.lower(F.trim(text)), r"^(yes|no|true|false)(?=$|[ ,.])", 1))
    return F.when(token.isin("yes", "true"), "yes").when(token.isin("no", "false"), "no")


def _parts(text: Column, separator: str = ",") -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def read_class_set(text: Column, classes: Sequence[str]) -> Column:
    """A sorted array of known classes; NULL for unknown tokens, for none among others, and for nothing at all.

    ``none`` alone is the set {None}, which is neither empty nor unreadable.
    """
    lowered = F.transform(_parts(text), lambda x: F.lower(x))
    names = F.create_map(*(x for c in [*classes, "None"] for x in (F.lit(c.lower()), F.lit(c))))
    known = F.transform(lowered, lambda x: F.element_at(names, x))
    legal = F.forall(known, lambda x: x.isNotNull()) & (F.size(known) > 0)
    mixed = F.array_contains(lowered, "none") & (F.size(F.array_distinct(lowered)) > 1)
    return F.when(legal & ~mixed, F.array_sort(F.array_distinct(known)))


def join_set(found: Column, empty: str = "none") -> Column:
    """A set as one sorted, comma-joined string."""
    return F.when(F.size(found) == 0, F.lit(empty)).otherwise(F.array_join(F.array_sort(found), ", "))


def loose_class_set(text: Column, classes: Sequence[str]) -> Column:
    """Known classes between ``,``, ``;`` and ``and``, final dots taken off; a whole text that says none is the empty set, an unknown part NULL."""
    whole = F.lower(F.regexp_replace(stripped(text), r"\.+$", ""))
    lowered = F.transform(F.filter(F.split(whole, r"[,;]| and "), lambda x: stripped(x) != ""), lambda x: F.regexp_replace(stripped(x), r"\.+$", ""))
    names = F.create_map(*(x for c in classes for x in (F.lit(c.lower()), F.lit(c))))
    known = F.transform(lowered, lambda x: F.element_at(names, x))
    legal = (F.size(known) > 0) & F.forall(known, lambda x: x.isNotNull())
    return F.when(whole.isin(*NONE_PHRASES), F.array().cast("array<string>")).when(legal, F.array_sort(F.array_distinct(known)))


def clamp_classes(text: Column, classes: Sequence[str]) -> Column:
    """Drops unknown parts if a known one is left, and none where classes stand beside it."""
    legal = F.array(*(F.lit(c.lower()) for c in classes))
    parts = _parts(text)
    kept = F.filter(parts, lambda x: F.array_contains(legal, F.lower(x)))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise(text)


def arbitrate(a: Column, b: Column, classes: Sequence[str]) -> tuple[Column, Column]:
    """(answer, changed): the shorter of two readable sets; ties and unreadable answers keep the first."""
    first, second = loose_class_set(a, classes), loose_class_set(b, classes)
    take = F.coalesce(F.size(second) < F.size(first), F.lit(False)) & first.isNotNull() & second.isNotNull()
    return F.when(take, join_set(second)).otherwise(a), take


def count_items(text: Column) -> Column:
    """Non-empty comma parts of the first line; NULL and empty have none."""
    return F.when(text.isNull(), 0).otherwise(F.size(_parts(F.substring_index(text, "\n", 1))))


def parse_count(text: Column) -> Column:
    """struct(answer, status): bare integer, ``counts: N``, exactly one integer, else 0 and malformed; leading zeros go."""
    bare = _nonempty(F.regexp_extract(text, r"^\s*(\d+)\s*$", 1))
    told = _nonempty(F.regexp_extract(text, r"(?i)[\"']?counts[\"']?\s*:\s*[\"']?(\d+)", 1))
    every = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    only = F.when(F.size(every) == 1, F.element_at(every, 1))
    status = F.when(bare.isNotNull(), "bare_int").when(told.isNotNull(), "structured").when(only.isNotNull(), "salvaged").otherwise("malformed")
    return F.struct(F.regexp_replace(F.coalesce(bare, told, only, F.lit("0")), r"^0+(?=\d)", "").alias("answer"), status.alias("status"))


def bare(text: Column) -> Column:
    """The text without white space at its ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def legality(text: Column, fmt: Column, classes: Sequence[str]) -> Column:
    """struct(legal, tag) of an answer for its format; the first violation names the tag, ``ok`` is none.

    Numbers are digits alone; yes or no stand alone; class lists name known classes (or
    ``none``), whatever the case, and have no two spaces in a row; other answers have a length.
    """
    told = bare(text)
    known = F.array(*(F.lit(c.lower()) for c in [*classes, "None"]))
    parts = F.filter(F.transform(F.split(F.lower(told), ","), bare), lambda x: x != "")
    unknown = F.filter(parts, lambda x: ~F.array_contains(known, x))
    number = (
        F.when(told.rlike(r"^\d+$"), "ok")
        .when(told.rlike(r"^\d+\s*\.$"), "trailing_period")
        .when(told.rlike(r"^\d+\s*[a-zA-Z]"), "number_plus_unit")
        .when(told.rlike(r"^\d+[.,]\d+$"), "decimal")
        .when(told.rlike(r"\d"), "number_in_prose")
        .otherwise("no_digits")
    )
    binary = F.when(F.lower(told).isin("yes", "no"), "ok").when(told.rlike(r"(?i)^(yes|no)\b"), "yesno_plus_text").otherwise("not_yesno")
    listed = (
        F.when(F.size(parts) == 0, "empty")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown_class:"), F.substring(F.element_at(unknown, 1), 1, 24)))
        .when(F.contains(told, F.lit("  ")), "whitespace")
        .otherwise("ok")
    )
    other = F.when(F.length(told) > 300, "over_300_chars").otherwise("ok")
    tag = F.when(told == "", "empty").when(fmt == "number", number).when(fmt == "binary", binary).when(fmt == "fo_class", listed).otherwise(other)
    return F.struct((tag == "ok").alias("legal"), tag.alias("tag"))


def as_number(text: Column) -> Column:
    """A text as double where it is a plain number (white space around it aside), else NULL."""
    return F.when(bare(text).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), bare(text).try_cast("double"))


def as_whole(text: Column) -> Column:
    """The whole part of a number; NULL for what is none."""
    number = as_number(text)
    return F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("long")


def split_thinking(text: Column, tag: str = "</think>") -> Column:
    """struct(trace, answer, closed): split at the last closing tag; without one there is no answer."""
    closed = F.contains(text, F.lit(tag))
    answer = F.when(closed, F.trim(F.substring_index(text, tag, -1))).otherwise("")
    trace = F.when(closed, F.left(text, F.length(text) - F.length(F.substring_index(text, tag, -1)) - len(tag))).otherwise(text)
    return F.struct(trace.alias("trace"), answer.alias("answer"), closed.alias("closed"))


def numbers_in(text: Column, most: int) -> Column:
    """All integers of a text in order, as far as they are no larger than ``most``."""
    every = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,9})"), F.lit(1)), lambda x: x.cast("int"))
    return F.filter(every, lambda x: x <= most)


def comparison_key(text: Column) -> Column:
    """Lower-cased comma parts in sorted order: equal for answers that differ in order or case only."""
    return F.array_join(F.array_sort(_parts(F.lower(text))), ",")


def mode_lowest(values: Column) -> Column:
    """The most frequent element of an array, the lowest on ties; NULL elements don't vote."""
    kept = F.filter(values, lambda x: x.isNotNull())
    counted = F.transform(F.array_distinct(kept), lambda v: F.struct((-F.size(F.filter(kept, lambda x: x == v))).alias("n"), v.alias("v")))
    return F.array_min(counted)["v"]


def vote_classes(sets: Column, classes: Sequence[str], threshold: int) -> Column:
    """Classes named in at least ``threshold`` of the sets, in vocabulary order; None if there are none."""
    vocabulary = F.array(*(F.lit(c) for c in classes))
    won = F.filter(vocabulary, lambda c: F.size(F.filter(sets, lambda s: F.array_contains(s, c))) >= threshold)
    return F.when(F.size(won) == 0, F.lit("None")).otherwise(F.array_join(won, ", "))


def tag_body(text: Column, tag: str) -> Column:
    """Trimmed body of the first ``<tag>...</tag>``, over lines; NULL without one."""
    found = F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(text.rlike(rf"(?s)<{tag}>.*?</{tag}>"), F.trim(found))


def correct_for(fmt: Column, pred: Column, gold: Column, classes: Sequence[str]) -> Column:
    """Right or wrong by the answer's format: equal sets, equal integers, equal yes or no; NULL where a judge is needed."""
    sets = read_class_set(pred, classes) == read_class_set(gold, classes)
    numbers = read_count(pred) == read_count(gold)
    binary = key_binary(pred) == key_binary(gold)
    return F.when(fmt == "fo_class", F.coalesce(sets, F.lit(False))).when(fmt == "number", F.coalesce(numbers, F.lit(False))).when(fmt == "binary", F.coalesce(binary, F.lit(False)))


def by_format(fmt: Column, readers: dict[str, Column], otherwise: Column) -> Column:
    """The reader that a format has, or ``otherwise``."""
    out = otherwise
    for name, reader in readers.items():
        out = F.when(fmt == name, reader).otherwise(out)
    return out


def bare_count(text: Column) -> Column:
    """The whole text as an integer, else NULL."""
    return _nonempty(F.regexp_extract(stripped(text), r"^(\d{1,9})$", 1)).cast("int")


def count_points(text: Column) -> Column:
    """Complete ``point_2d`` pairs in a text, those of a list that breaks off too."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"""["']point_2d["']\s*:\s*[\[(]\s*-?[\d.]+\s*,\s*-?[\d.]+\s*[\])]"""))


def last_number(text: Column) -> Column:
    """The largest number of a numbered list; 0 for an answer that says none, NULL for anything else."""
    bare = stripped(text)
    numbers = F.transform(F.regexp_extract_all(bare, F.lit(r"(?m)^\s*(\d{1,9})[.)]"), F.lit(1)), lambda x: x.cast("int"))
    return F.when(F.size(numbers) > 0, F.array_max(numbers)).when(F.lower(bare).isin("", "none", "no objects", "nothing"), 0)


def points_in(text: Column) -> Column:
    """struct(status, points): pairs of the first JSON list; ``unparseable`` without one, ``malformed`` with no pair in it."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\[.*\])", 1)
    elements = F.from_json(found, "array<string>")
    pair = lambda x: F.coalesce(F.from_json(x, "array<double>"), F.array().cast("array<double>"))
    named = lambda x: F.from_json(x, "struct<x:double,y:double>")
    points = F.transform(elements, lambda x: F.coalesce(F.when(F.size(pair(x)) >= 2, F.struct(F.get(pair(x), F.lit(0)).alias("x"), F.get(pair(x), F.lit(1)).alias("y"))), F.struct(named(x)["x"].alias("x"), named(x)["y"].alias("y"))))
    whole = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    status = F.when(elements.isNull(), "unparseable").when((F.size(whole) == 0) & (F.size(elements) > 0), "malformed").otherwise("ok")
    return F.struct(status.alias("status"), F.coalesce(whole, F.array().cast("array<struct<x:double,y:double>>")).alias("points"))


def canonical_classes(text: Column, accepted: Sequence[str], definitions: str) -> Column:
    """A class list made legal, or the trimmed text as it is.

    none goes where classes stand beside it.  Unknown parts go only if a known one is left,
    every part looks like a name, and no unknown one occurs in the served definitions.
    """
    known = F.array(*(F.lit(c.lower()) for c in [*accepted, "none"]))
    is_known = lambda x: F.array_contains(known, F.lower(x))
    bare = stripped(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(bare, ","), lambda x: stripped(x)), lambda x: x != "")
    named = F.filter(parts, lambda x: F.lower(x) != "none")
    rest = F.when(F.size(named) > 0, named).otherwise(parts)
    kept, unknown = F.filter(rest, is_known), F.filter(rest, lambda x: ~is_known(x))
    shaped = F.forall(rest, lambda x: x.rlike(r"^[A-Za-z][A-Za-z \-]{0,30}$"))
    documented = F.exists(unknown, lambda x: F.contains(F.lit(definitions.lower()), F.lower(x)))
    legal = F.when((F.size(unknown) > 0) & shaped & (F.size(kept) > 0) & ~documented, kept).otherwise(rest)
    return F.when(F.exists(parts, is_known), F.array_join(legal, ", ")).otherwise(bare)


def meant_and_valid(text: Column, fmt: Column) -> Column:
    """struct(value, is_zero, parsed, valid): what an answer means, read leniently, and whether a strict reader takes it."""
    bare = stripped(F.coalesce(text, F.lit("")))
    number = F.regexp_replace(_nonempty(F.regexp_extract(bare, r"^(\d+)", 1)), r"^0+(?=\d)", "")
    word = F.nullif(F.lower(F.regexp_extract(bare, r"(?i)^(yes|no)\b", 1)), F.lit(""))
    is_number = fmt == "number"
    value = F.when(is_number, number).otherwise(word)
    valid = F.when(is_number, bare.rlike(r"^\d+$")).otherwise(F.lower(bare).isin("yes", "no"))
    zero = F.when(is_number, value == "0").otherwise(value == "no")
    return F.struct(value.alias("value"), F.coalesce(zero, F.lit(False)).alias("is_zero"), value.isNotNull().alias("parsed"), valid.alias("valid"))


# How the labelled files say that there is nothing, and mark a reference.
NO_TOOLS = "no tools detected"
REFERENCE_TOKEN = "<|object_ref_start|>"


def boxes_count(text: Column) -> Column:
    """struct(count, names, category) of a labelled answer: zero, corrupted_ref, clean, or unparsed with no count."""
    bare = stripped(F.coalesce(text, F.lit("")))
    pair = r"\(\s*\d+\s*,\s*\d+\s*\)"
    names = F.transform(F.regexp_extract_all(bare, F.lit(rf"([A-Za-z][A-Za-z ]*?)\s*{pair}\s*,\s*{pair}"), F.lit(1)), lambda x: stripped(x))
    refs = (F.length(bare) - F.length(F.replace(bare, F.lit(REFERENCE_TOKEN), F.lit("")))) / len(REFERENCE_TOKEN)
    category = F.when(F.startswith(F.lower(bare), F.lit(NO_TOOLS)), "zero").when(refs > 0, "corrupted_ref").when(F.size(names) > 0, "clean").otherwise("unparsed")
    count = F.when(category == "zero", 0).when(category == "corrupted_ref", refs.cast("int")).when(category == "clean", F.size(names))
    return F.struct(count.alias("count"), F.when(category == "clean", names).otherwise(F.array().cast("array<string>")).alias("names"), category.alias("category"))


def padded_video(path: Column) -> Column:
    """``/VID2/`` as ``/VID02/``; longer numbers keep their digits, without leading zeros."""
    return F.regexp_replace(F.regexp_replace(path, r"/VID0*(\d+)/", "/VID$1/"), r"/VID(\d)/", "/VID0$1/")
