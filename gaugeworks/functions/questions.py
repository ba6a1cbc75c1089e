"""Questions, clock times and corpus rows: projections and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the answer groups by leaf code (fixed values).
GROUPS = {"1": "object_recognition", "2": "temporal_grounding", "3": "aggregation", "4": "event_understanding", "5": "complex_reasoning"}


def template_of(question: Column) -> Column:
    """The question with every clock time replaced by ``<TS>``."""
    return F.regexp_replace(question, r"\d{2}:\d{2}:\d{2}", "<TS>")


def leaf_group(leaf: Column) -> Column:
    """Group of a leaf code such as ``3a``; NULL where it has none (see ``gates.every_leaf_has_group``)."""
    groups = F.create_map(*(F.lit(x) for pair in GROUPS.items() for x in pair))
    return F.when(leaf.rlike("^[1-5][a-e]$"), F.element_at(groups, F.substring(leaf, 1, 1)))


def distribution_of(qid: Column, shifted: str = "heico") -> Column:
    """OOD for the shifted data set's prefix, ID for any other."""
    return F.when(F.substring_index(qid, "__", 1) == shifted, "OOD").otherwise("ID")


def item_id(dataset: Column, key: Column) -> Column:
    return F.concat_ws("__", dataset, key.cast("string"))


def cache_name(*parts: Column) -> Column:
    """Parts with runs of other than letters and digits as one ``_``, trimmed, joined by ``__``."""
    return F.concat_ws("__", *(F.trim(F.regexp_replace(p.cast("string"), r"[^A-Za-z0-9]+", "_"), F.lit("_")) for p in parts))


def clock_seconds(text: Column) -> Column:
    """hh:mm:ss to seconds as double; hours are not limited; NULL if it isn't one."""
    parts = F.split(text, ":")
    value = F.get(parts, F.lit(0)).cast("double") * 3600 + F.get(parts, F.lit(1)).cast("double") * 60 + F.get(parts, F.lit(2)).cast("double")
    return F.when(text.rlike(r"^\d+:\d{2}:\d{2}(\.\d+)?$"), value)


def seconds_clock(seconds: Column) -> Column:
    """Seconds to hh:mm:ss: half-even rounding, nothing below zero, hours beyond 24 kept."""
    whole = F.greatest(F.bround(seconds, 0), F.lit(0.0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)


def needs_time_grid(question: Column) -> Column:
    return F.contains(question, F.lit("hh:mm:ss")) | F.contains(question, F.lit("In %")) | F.contains(question, F.lit("format xx%"))


def threshold_seconds(duration: Column) -> Column:
    """Tolerance that grows with the clip, five seconds at most."""
    return F.least(F.lit(5.0), F.lit(1.0) + duration * F.lit(4.0) / F.lit(360.0))


def frames_for(duration: Column, routed: Column) -> Column:
    """Four frames, or on a grid no coarser than the tolerance."""
    return F.when(~routed, F.lit(4)).otherwise(F.ceil(duration / threshold_seconds(duration)).cast("int") + 1)


def frame_indices(start: Column, duration: Column, k: Column, fps: float, n_frames: Column | None = None) -> Column:
    """Distinct frame numbers of k evenly spaced points, in order, none past the last frame."""
    last = F.greatest(k - 1, F.lit(1))
    grid = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround((start + duration * i / last) * F.lit(fps), 0).cast("long"))
    return F.array_distinct(grid if n_frames is None else F.transform(grid, lambda x: F.least(x, n_frames - 1)))


def shift_clock(text: Column, start: Column) -> Column:
    """Comma-separated relative times moved by ``start``; untouched if any part isn't a time."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    moved = F.transform(parts, lambda x: seconds_clock(clock_seconds(x) + start))
    return F.when(F.forall(parts, lambda x: x.rlike(r"^\d+:\d{2}:\d{2}$")), F.array_join(moved, ", ")).otherwise(text)


def swap_sides(text: Column) -> Column:
    """left and right exchanged in every ``top/left`` or ``bottom/right``, case kept; other words stay."""
    out = text
    place = r"\b((?i:top|bottom)/)"
    for one, two in (("left", "right"), ("Left", "Right"), ("LEFT", "RIGHT")):
        out = F.regexp_replace(out, rf"{place}{one}\b", "$1\u0001")
        out = F.regexp_replace(out, rf"{place}{two}\b", f"$1{one}")
        out = F.replace(out, F.lit("\u0001"), F.lit(two))
    return out


def add_count_prefix(answer: Column, n: Column) -> Column:
    """``N: answer``; an earlier prefix is replaced."""
    return F.concat(n.cast("string"), F.lit(": "), strip_count_prefix(answer))


def strip_count_prefix(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*\d+:\s*", "")


def stated_count(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\s*(\d+):", 1), F.lit("")).cast("int")


def strip_leading(question: Column, premise: str) -> Column:
    """Drops leading sentences that match ``premise``; unchanged if nothing would be left."""
    rest = F.regexp_replace(question, rf"^(?:(?=[^.!?]*{premise})[^.!?]*[.!?]\s*)+", "")
    return F.when(F.trim(rest) == "", question).otherwise(rest)


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")


def first_column(rows: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of several names that a table has; raises if it has none."""
    for name in names:
        if name in rows.columns:
            return F.col(name)
    raise KeyError(f"none of {names} in {rows.columns}")


def mentions(question: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a question has one of the phrases, whatever the case."""
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(F.lower(question), F.lit(phrase))
    return out


def every_nth(values: Column, n: int) -> Column:
    """Elements 0, n, 2n, ... of an array."""
    return F.filter(values, lambda x, i: i % n == 0)


def nearest_of_grid(at: Column, duration: Column, k: Column) -> Column:
    """The point nearest to ``at`` of k evenly spaced ones from 0 to ``duration``."""
    step = duration / (k - 1)
    return F.least(F.greatest(F.bround(at / step, 0), F.lit(0.0)), (k - 1).cast("double")) * step


def count_label(question: Column) -> Column:
    """What a question asks the number of; NULL for any other question."""
    return F.nullif(F.regexp_extract(question, r"(?i)^how many (.+?) are\b", 1), F.lit(""))


def count_target(label: Column, n: Column) -> Column:
    return F.to_json(F.struct(label.alias("label"), n.alias("counts")))


def is_duration(question: Column) -> Column:
    """Whether a question asks how long something lasts, so that its answer is no place in time."""
    return F.lower(question).rlike(r"\bhow long\b")


def chat_row(system: str, question: Column, answer: Column, is_time: Column, video: Column, start: Column, duration: Column, k: Column, stride: Column, fps: float, n_frames: Column) -> Column:
    """struct(messages, videos, raw_fps, meta) of a clip's question.

    Frames are every ``stride``-th of the grid of k points, as many as it has after
    repeated ones and those past the end are taken together.  Times in the answer become
    times in the clip, as many as they were, unless they say how long something lasts.
    """
    grid = frame_indices(start, duration, k, fps, n_frames)
    taken = F.filter(grid, lambda x, i: i % stride == 0)
    n = F.size(taken)
    kind = F.when(is_time & is_duration(question), "2b_elapsed").when(is_time, "2a_relative")
    told = F.when(kind == "2a_relative", shift_clock(answer, -start)).otherwise(answer)
    window = F.concat(F.lit("Clip ["), seconds_clock(start), F.lit(" - "), seconds_clock(start + duration), F.lit("] of the procedure."))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.struct(
        F.array(message("system", F.lit(system)), message("user", F.concat(F.lit("<video>"), window, F.lit("\n"), question)), message("assistant", told)).alias("messages"),
        F.transform(taken, lambda i: F.concat(video, F.lit("/"), i.cast("string"))).alias("videos"),
        F.bround(F.when((duration > 0) & (n > 1), (n - 1) / duration).otherwise(1.0), 6).alias("raw_fps"),
        F.struct(n.alias("k"), k.alias("k_fine"), stride.alias("stride"), kind.alias("time_kind"), answer.alias("gold_original")).alias("meta"),
    )
