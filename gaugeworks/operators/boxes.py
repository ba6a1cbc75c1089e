"""Boxes on frames: suppression of overlaps, and whether what is on one frame is still there on the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.gates import GateError

#: Boxes of one frame at most: the fold of a frame is one row.
MOST_BOXES = 1024
#: Cells in a row of the grid that a frame is cut into, by the size of its boxes: a box lies in a few.
CELL = 16.0

BOX = "x0", "y0", "x1", "y1"


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs of x0, y0, x1, y1); 0 where both are empty."""
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    inter = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def suppressed(boxes: DataFrame, frame: str, key: str, most: float) -> DataFrame:
    """The boxes of every frame that stay: largest first, one that overlaps a larger kept one by ``most`` or more goes.

    ``boxes``: frame, key, x0, y0, x1, y1.  Of equal areas the smaller key comes first.  A frame
    is one array, folded where it lies; more than ``MOST_BOXES`` on one raise.
    """
    crowd = boxes.groupBy(frame).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if crowd > MOST_BOXES:
        raise GateError(f"a frame has {crowd} boxes, at most {MOST_BOXES}")
    box = F.struct(*(F.col(c).cast("double").alias(c) for c in BOX))
    every = boxes.select(frame, F.struct((-area(box)).alias("order"), F.col(key).alias("key"), box.alias("box")).alias("b")).groupBy(frame).agg(F.array_sort(F.collect_list("b")).alias("every"))
    none = F.filter("every", lambda b: F.lit(False))
    fold = F.aggregate("every", none, lambda kept, b: F.when(F.exists(kept, lambda k: overlap_ratio(k["box"], b["box"]) >= F.lit(most)), kept).otherwise(F.concat(kept, F.array(b))))
    return every.select(frame, F.explode(fold).alias("b")).select(frame, F.col("b.key").alias(key), *(F.col(f"b.box.{c}").alias(c) for c in BOX))


def persistence(boxes: DataFrame, video: str, at: str, key: str, survive: float = 0.5, cell: float = CELL) -> DataFrame:
    """video, at, n_seed, n_survived, persistence, mean_ratio for every frame that a next one follows.

    Each box is held against the boxes of the same video's next frame (the next ``at``
    there is) and has its best overlap there; it survives with ``survive`` or more.  Boxes
    meet in the cells of a grid that both lie in, so what doesn't touch isn't compared;
    a box without any partner overlaps by 0.
    """
    frames = boxes.select(video, at).distinct()
    following = frames.withColumn("next_at", F.lead(at).over(Window.partitionBy(video).orderBy(at))).filter("next_at is not null")
    seeds = boxes.join(following, [video, at])
    spans = [F.sequence(F.floor(F.least(lo, hi) / F.lit(cell)), F.floor(F.greatest(lo, hi) / F.lit(cell))) for lo, hi in (("x0", "x1"), ("y0", "y1"))]
    in_cells = lambda df: df.withColumn("cx", F.explode(spans[0])).withColumn("cy", F.explode(spans[1]))
    box = F.struct(*(F.col(c).cast("double").alias(c) for c in BOX))
    a = in_cells(seeds).select(video, at, "next_at", F.col(key).alias("key_a"), box.alias("a"), "cx", "cy")
    b = in_cells(boxes).select(video, F.col(at).alias("next_at"), box.alias("b"), "cx", "cy")
    best = a.join(b, [video, "next_at", "cx", "cy"]).groupBy(video, at, "key_a").agg(F.max(overlap_ratio(F.col("a"), F.col("b"))).alias("ratio"))
    scored = seeds.select(video, at, F.col(key).alias("key_a")).join(best, [video, at, "key_a"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    return scored.groupBy(video, at).agg(
        F.count(F.lit(1)).alias("n_seed"),
        F.count_if(F.col("ratio") >= F.lit(survive)).alias("n_survived"),
        F.avg((F.col("ratio") >= F.lit(survive)).cast("double")).alias("persistence"),
        F.avg("ratio").alias("mean_ratio"),
    )


def persistence_verdict(jumps: Column, stable: Column, eps: float = 0.10, low: float = 0.50) -> Column:
    """LABEL where persistence is alike in both arms, SCENE where it is lower at jumps; NO_VERDICT where both are low, the jumps persist better, or one is missing."""
    apart = jumps - stable
    return (
        F.when(jumps.isNull() | stable.isNull(), "NO_VERDICT")
        .when((jumps < low) & (stable < low), "NO_VERDICT")
        .when(F.abs(apart) < eps, "LABEL")
        .when(apart < 0, "SCENE")
        .otherwise("NO_VERDICT")
    )
