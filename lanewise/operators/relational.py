"""Joins and windows over detections, points and trajectories."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import geometry as G


def lane_of(points: DataFrame, lanes: list[tuple[int, list[tuple[float, float]]]], x: str = "x", y: str = "y") -> DataFrame:
    """points with lane: the first of the annotated polygons that holds the point, else -1.

    A road's polygons are few and part of its configuration, so they become compiled arithmetic on each point: no join, no shuffle.
    """
    lane = F.lit(-1)
    for n, ring in reversed(lanes):
        lane = F.when(G.inside_ring(F.col(x), F.col(y), ring), n).otherwise(lane)
    return points.withColumn("lane", lane)


def clamped_clock(frames: DataFrame, clock: DataFrame) -> DataFrame:
    """frames with the clock's row of the same video and frame; frames past a clock's end get its last entry, those of a video without a clock nulls."""
    last = clock.groupBy("video_id").agg(F.max("frame_index").alias("_last"))
    both = frames.join(last, "video_id", "left").withColumn("_at", F.least("frame_index", "_last"))
    return both.join(clock.withColumnRenamed("frame_index", "_at"), ["video_id", "_at"], "left").drop("_at", "_last")


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """left with the value of the first row of right of the same key that is not earlier; a union and one window, no range join."""
    tagged = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    other = right.select(*by, on, F.col(value).alias("_value")).withColumn("_side", F.lit(0))
    after = Window.partitionBy(*by).orderBy(F.desc(on), F.desc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = tagged.unionByName(other, allowMissingColumns=True)
    return joined.withColumn(value, F.last("_value", ignorenulls=True).over(after)).filter("_side = 1").drop("_side", "_value")


def pairs_in_frame(boxes: DataFrame, frame: str = "frame_index", order: str = "det_id") -> DataFrame:
    """Each two boxes of a frame (a before b) that overlap, with their iou. Boxes: frame, order, l, t, r, b."""
    names = ("l", "t", "r", "b")
    a = boxes.select(frame, F.col(order).alias("a"), *[F.col(c).alias(f"a_{c}") for c in names])
    b = boxes.select(frame, F.col(order).alias("b"), *[F.col(c).alias(f"b_{c}") for c in names])
    touch = (F.col("a") < F.col("b")) & (F.col("a_l") < F.col("b_r")) & (F.col("b_l") < F.col("a_r")) & (F.col("a_t") < F.col("b_b")) & (F.col("b_t") < F.col("a_b"))
    both = a.join(b, frame).filter(touch)
    return both.select(frame, "a", "b", G.iou([F.col(f"a_{c}") for c in names], [F.col(f"b_{c}") for c in names]).alias("iou"))


def only_overlaps(pairs: DataFrame, least: float, frame: str = "frame_index") -> DataFrame:
    """Pairs at or over the threshold whose two members have no other such pair: they need no solver."""
    strong = pairs.filter(F.col("iou") >= least)
    of_a, of_b = Window.partitionBy(frame, "a"), Window.partitionBy(frame, "b")
    alone = (F.col("_a") == 1) & (F.col("_b") == 1)
    return strong.withColumns({"_a": F.count("*").over(of_a), "_b": F.count("*").over(of_b)}).filter(alone).drop("_a", "_b")


def centred_mean(df: DataFrame, value: str, by: list[str], order: str, radius: int) -> Column:
    """Moving average of 2 * radius + 1 rows whose missing neighbours are the first and last value of the key."""
    w = Window.partitionBy(*by).orderBy(order)
    near, all_rows = w.rowsBetween(-radius, radius), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at, n = F.row_number().over(w), F.count("*").over(all_rows)
    before, after = F.greatest(F.lit(0), radius + 1 - at), F.greatest(F.lit(0), at + radius - n)
    total = F.sum(value).over(near) + before * F.first(value).over(all_rows) + after * F.last(value).over(all_rows)
    return total / (2 * radius + 1)


def runs(df: DataFrame, by: list[str], order: str = "frame_index") -> DataFrame:
    """df with run: a new one starts where the step to the row before is over 1. Equal frames stay together."""
    w = Window.partitionBy(*by).orderBy(order)
    breaks = F.when(F.abs(F.col(order) - F.lag(order).over(w)) > 1, 1).otherwise(0)
    return df.withColumn("_break", breaks).withColumn("run", F.sum("_break").over(w)).drop("_break")


def longest_run(df: DataFrame, by: list[str], order: str = "frame_index") -> DataFrame:
    """One row a key: first, last and n of its longest run; of equal ones the first."""
    each = runs(df, by, order).groupBy(*by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    best = F.max_by(F.struct("first", "last", "n"), F.struct("n", -F.col("first"))).alias("best")
    return each.groupBy(*by).agg(best).select(*by, "best.*")


def in_region(points: DataFrame, ring: Column, by: list[str], least: int = 5) -> DataFrame:
    """Points whose truncated place is inside the region, of keys with more than `least` of them, cut to the key's longest run."""
    x, y = F.col("x").cast("int").cast("double"), F.col("y").cast("int").cast("double")
    kept = points.filter((F.col("x") >= 0) & (F.col("y") >= 0) & G.inside(x, y, ring))
    many = kept.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).filter(F.col("_n") > least).drop("_n")
    best = longest_run(many, by).select(*by, F.col("first").alias("_first"), F.col("last").alias("_last"))
    return many.join(best, by).filter(F.col("frame_index").between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def trail(points: DataFrame, by: list[str], order: str, keep: int = 30) -> DataFrame:
    """points with trail: the places of the last `keep` rows of the key, oldest first."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - keep, Window.currentRow)
    return points.withColumn("trail", F.collect_list(F.struct("x", "y")).over(w))


def last_samples(features: DataFrame, target: str, order: str, budget: int, active: DataFrame | None = None) -> DataFrame:
    """The newest `budget` samples of each target, of the active targets alone if they are given. The rank filter drops rows before the shuffle."""
    features = features if active is None else features.join(active.select(target), target, "left_semi")
    w = Window.partitionBy(target).orderBy(F.desc(order))
    return features.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= budget).drop("_n")


def peaks(cells: DataFrame, by: list[str], row: str = "y", col: str = "x", value: str = "v") -> DataFrame:
    """Cells of a grid that are the greatest of their 3 x 3 surroundings. Each cell gives its value to its nine places."""
    nine = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    given = cells.select(*by, row, col, value, nine.alias("d")).select(*by, (F.col(row) + F.col("d.i")).alias(row), (F.col(col) + F.col("d.j")).alias(col), value, ((F.col("d.i") == 0) & (F.col("d.j") == 0)).alias("own"))
    best = given.groupBy(*by, row, col).agg(F.max(value).alias("_top"), F.max(F.when(F.col("own"), F.col(value))).alias(value))
    return best.filter(F.col(value) == F.col("_top")).drop("_top")


def top_detections(df: DataFrame, by: list[str], score: str, k: int, ties: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tile_starts(length: int, size: int, gap: int) -> list[int]:
    """Where tiles start along one side: steps of size - gap, the last moved back to the border."""
    out, at = [], 0
    while True:
        out.append(max(0, min(at, length - size)))
        if at + size >= length:
            return sorted(set(out))
        at += size - gap


def in_spans(value: Column, spans: list[tuple[int, int]]) -> Column:
    """Whether value is in any of the closed spans; false for null."""
    held = F.lit(False)
    for lo, hi in spans:
        held = held | value.between(lo, hi)
    return F.coalesce(held, F.lit(False))


def common_rate(p: Column, q: Column) -> tuple[Column, Column, Column]:
    """The greatest common divisor of two frame rates, and every how many frames of each it keeps."""
    both = F.filter(F.sequence(F.lit(1), F.least(p, q)), lambda d: (p % d == 0) & (q % d == 0))
    g = F.array_max(both)
    return g, (p / g).cast("int"), (q / g).cast("int")


def cosine_rate(epoch: Column, epochs: int, least: float) -> Column:
    """A factor that falls from 1 to `least` along half a cosine."""
    return (1 + F.cos(epoch * math.pi / epochs)) / 2 * (1 - least) + least


def every_nth(frame: Column, rate: float, wanted: float, start: Column | int = 0) -> Column:
    """Whether a frame is kept to bring a rate to the wanted one: each gap-th since `start`; gap is rounded half to even."""
    gap = F.bround(F.lit(float(rate)) / F.lit(float(wanted))).cast("long")
    return (frame - start) % gap == 0


def squared_distance(gaps: list[Column], variances: list[Column]) -> Column:
    """Squared Mahalanobis distance for a diagonal covariance."""
    return sum((g * g / v for g, v in zip(gaps[1:], variances[1:], strict=True)), gaps[0] * gaps[0] / variances[0])


def top_over_classes(df: DataFrame, by: list[str], cls: str, score: str, k: int, ties: list[str]) -> DataFrame:
    """The k best of each class first, then the k best of those over all classes, with rank: two grouped limits, each before its shuffle."""
    return top_detections(top_detections(df, [*by, cls], score, k, ties).drop("rank"), by, score, k, ties)


def overlapping_lists(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two lists share a member."""
    return df.filter(F.arrays_overlap(a, b))


def in_order_of_start(trajectories: DataFrame, key: str, first: str = "first") -> DataFrame:
    return trajectories.orderBy(first, key)
