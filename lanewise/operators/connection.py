"""Connecting the trajectories of many videos: maps between planes and clocks, matching along an edge, the search for a clock offset, result tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import affine
from lanewise.operators import matching as M, relational as R, trajectories as T

#: Pairs over the gate wait for the second round; matches at or over the limit don't count; first frames of an edge's vehicles.
GATE, LIMIT, HORIZON = 300.0, 1000.0, (0, 3001)


def mapped(points: DataFrame, maps: DataFrame, by: list[str], geo: tuple[str, ...] = ("line_pos", "line_offset")) -> DataFrame:
    """points with x, y through the map of their key; x_raw, y_raw keep the first pixels, and a second call starts from them. Columns in geo become null.

    maps: by, map. Keys without a map keep their places.
    """
    raw = {c: F.coalesce(f"{c}_raw", c) if f"{c}_raw" in points.columns else F.col(c) for c in ("x", "y")}
    both = points.withColumns({f"{c}_raw": v for c, v in raw.items()}).join(maps.select(*by, F.col("map").alias("_map")), by, "left")
    x, y = affine.applied(F.col("_map"), F.col("x_raw"), F.col("y_raw"))
    out = both.withColumns({"x": F.coalesce(x, "x_raw"), "y": F.coalesce(y, "y_raw")}).drop("_map")
    return out.withColumns({c: F.lit(None).cast("double") for c in geo if c in points.columns})


def mapped_lines(lines: DataFrame, maps: DataFrame, by: list[str], points: str = "points") -> DataFrame:
    """lines with their points through the map of their key, as mapped() has single places: driving lines in the main video's plane. Lines of keys without a map go."""
    moved = lambda p: F.struct(*[v.alias(n) for n, v in zip("xy", affine.applied(F.col("_map"), p.x, p.y), strict=True)])
    both = lines.join(maps.select(*by, F.col("map").alias("_map")), by)
    return both.withColumn(points, F.transform(points, moved)).drop("_map")


def retimed(points: DataFrame, clocks: DataFrame, main: DataFrame, by: list[str]) -> DataFrame:
    """points with frame_index in the main video's numbering; frame_raw keeps the first, and a second call starts from it.

    clocks: by, first_frame, start_ms, delta_ms, perhaps offset (frames); main: one row of the same without by.
    """
    raw = F.coalesce("frame_raw", "frame_index") if "frame_raw" in points.columns else F.col("frame_index")
    one = main.select(F.struct("first_frame", "start_ms", "delta_ms").alias("_main")).limit(1)
    shift = F.col("offset") * F.col("delta_ms") if "offset" in clocks.columns else F.lit(0.0)
    own = clocks.select(*by, F.struct("first_frame", (F.col("start_ms") + shift).alias("start_ms"), "delta_ms").alias("_own"))
    both = points.withColumn("frame_raw", raw).join(own, by).crossJoin(F.broadcast(one))
    frame = T.reindexed(F.col("frame_raw"), F.col("_own.start_ms"), F.col("_own.delta_ms"), F.col("_main.start_ms"), F.col("_main.delta_ms"), F.col("_main.first_frame"), F.col("_own.first_frame"))
    return both.withColumn("frame_index", frame).drop("_own", "_main")


def aligned(points: DataFrame, paths: DataFrame, clocks: DataFrame, main_clock: DataFrame, by: str = "video_id") -> DataFrame:
    """Every video's points in the main video's plane and frame numbering. paths: node, shift (frames), map, from graphs.paths_to_root()."""
    maps = paths.select(F.col("node").alias(by), "map")
    timed = clocks.drop("offset").join(paths.select(F.col("node").alias(by), F.col("shift").alias("offset")), by)
    return retimed(mapped(points, maps, [by]), timed, main_clock, [by])


def within_horizon(points: DataFrame, by: list[str], lo: int = HORIZON[0], hi: int = HORIZON[1]) -> DataFrame:
    """Points of keys whose first frame is at least lo and before hi: a semi join."""
    first = points.groupBy(*by).agg(F.min("frame_index").alias("_f")).filter((F.col("_f") >= lo) & (F.col("_f") < hi))
    return points.join(first, by, "left_semi")


def touching_horizon(points: DataFrame, by: list[str], lo: int, hi: int) -> DataFrame:
    """Points of keys whose first or last frame is between lo and hi."""
    ends = points.groupBy(*by).agg(F.min("frame_index").alias("_f"), F.max("frame_index").alias("_l"))
    return points.join(ends.filter(F.col("_f").between(lo, hi) | F.col("_l").between(lo, hi)), by, "left_semi")


Similarity = Callable[[DataFrame, DataFrame, list[str]], DataFrame]


def similar(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return T.similarity(left, right, by=by)


def matched_vehicles(left: DataFrame, right: DataFrame, block: str, gate: float = GATE, similarity: Similarity = similar) -> DataFrame:
    """block, a, b, cost, stage, accepted: vehicles of two videos matched in two rounds within each block. left: block, a and right: block, b, with points.

    similarity(left, right, [block]) gives block, a, b, dist; callers may bring their own.
    """
    pairs = similarity(left, right, [block]).withColumnRenamed("dist", "cost")
    return M.split_by_distance(M.two_stage(pairs, block, gate), LIMIT)


def edge_matches(main: DataFrame, sub: DataFrame, edges: DataFrame, clocks: DataFrame, main_clocks: DataFrame, region: Column | None = None, similarity: Similarity = similar) -> dict[str, DataFrame]:
    """The work of an edge, for all edges at once: map, re-number, cut to the region and the horizon, match, split.

    main: edge, a, frame_index, x, y, lane_id; sub: edge, b and the same; edges: edge, map; clocks: edge, first_frame, start_ms, delta_ms, offset; main_clocks: the same for the
    main side. Gives `matches` (see matched_vehicles), `rest_main`, `rest_sub` (vehicles without a partner) and `quality` (edge, n, mean of accepted costs).
    """
    moved = mapped(sub, edges, ["edge"]).join(clocks, "edge").join(main_clocks.select("edge", F.struct("first_frame", "start_ms", "delta_ms").alias("_m")), "edge")
    start = F.col("start_ms") + F.col("offset") * F.col("delta_ms")
    moved = moved.withColumn("frame_index", T.reindexed(F.col("frame_index"), start, F.col("delta_ms"), F.col("_m.start_ms"), F.col("_m.delta_ms"), F.col("_m.first_frame"), F.col("first_frame")))
    sides = {}
    for name, side, key in (("main", main, "a"), ("sub", moved, "b")):
        kept = side if region is None else R.in_region(side, region, ["edge", key])
        sides[name] = within_horizon(kept, ["edge", key]).select("edge", key, "frame_index", "x", "y", "lane_id")
    found = matched_vehicles(sides["main"], sides["sub"], "edge", similarity=similarity)
    good = found.filter("accepted")
    rest = lambda side, key: sides[side].select("edge", key).distinct().join(good.select("edge", key), ["edge", key], "left_anti")
    quality = found.groupBy("edge").agg(F.count_if("accepted").alias("n"), F.avg(F.when(F.col("accepted"), F.col("cost"))).alias("mean"))
    return {"matches": found, "rest_main": rest("main", "a"), "rest_sub": rest("sub", "b"), "quality": quality}


def offset_quality(left: DataFrame, right: DataFrame, radius: int, gate: float = GATE, similarity: Similarity = similar) -> DataFrame:
    """edge, offset, place, n, mean: how well the edge's vehicles match when the right side's frames are moved by each offset, 0, 1, -1, 2, ... up to radius.

    One plan for all edges and offsets: a block is an edge and an offset.
    """
    offsets = T.search_order(radius)
    block = F.struct("edge", "offset").alias("block")
    a = left.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("block", block)
    found = matched_vehicles(a, T.shifted(right, offsets).withColumn("block", block), "block", gate, similarity)
    mean = F.avg(F.when(F.col("accepted"), F.col("cost")))
    per = found.groupBy("block").agg(F.count_if("accepted").alias("n"), mean.alias("mean")).select("block.edge", "block.offset", "n", "mean")
    return per.withColumn("place", F.array_position(F.array(*[F.lit(o) for o in offsets]), F.col("offset")).cast("int"))


def best_offsets(quality: DataFrame) -> DataFrame:
    """edge, offset, n, mean of the best offset in the order of search, as far as the search goes.

    It stops after an offset on the side of the best so far, if that is below 100 and the offset's mean is above twice the best, and above 100. Offsets without a match don't count.
    """
    before = Window.partitionBy("edge").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(F.when(F.col("mean").isNotNull(), F.struct("mean", "place", "offset"))).over(before)
    rows = quality.withColumn("_best", best)
    stop = (F.col("offset") * F.col("_best.offset") > 0) & (F.col("_best.mean") < 100) & (F.col("mean") > F.greatest(2 * F.col("_best.mean"), F.lit(100.0)))
    rows = rows.withColumn("_stops", F.count_if(stop).over(before))
    chosen = F.min_by(F.struct("offset", "n", "mean"), F.struct("mean", "place")).alias("c")
    return rows.filter((F.col("_stops") == 0) & F.col("mean").isNotNull()).groupBy("edge").agg(chosen).select("edge", "c.*")


def match_tables(matches: DataFrame, rest_main: DataFrame, rest_sub: DataFrame, block: str = "edge") -> dict[str, DataFrame]:
    """The three tables of an edge, ids as text: `match_` and `not_match_` (pairs under and over the limit, in the order of the main id), `not_match_single_`."""

    def lists(rows: DataFrame) -> DataFrame:
        held = rows.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_p"))
        text = lambda side: F.array_join(F.transform("_p", lambda p: p[side].cast("string")), ";")
        return held.select(block, text("a").alias("main_ids"), text("b").alias("sub_ids"))

    def alone(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy(block).agg(F.array_join(F.sort_array(F.collect_list(key)), ";").alias(name))

    single = alone(rest_main, "a", "main_ids").join(alone(rest_sub, "b", "sub_ids"), block, "full")
    return {"match_": lists(matches.filter("accepted")), "not_match_": lists(matches.filter("not accepted")), "not_match_single_": single}


def is_anchor(frame: int, every: int, spans: list[tuple[int, int]]) -> bool:
    """Whether a frame becomes the one that the next are mapped to."""
    return frame % every == 0 and not any(lo <= frame <= hi for lo, hi in spans)


def cumulated(steps: DataFrame, video: str, every: int = 30, skip: list[tuple[int, int]] | None = None) -> DataFrame:
    """video, frame_index, map: each frame's map to the video's first frame. steps: video, frame_index, map (to the anchor before the frame).

    A frame whose number is a multiple of `every`, outside the skipped spans, becomes the next anchor: its map is that of the anchor before, times its step. The product of anchors
    runs along the video, frame by frame, with six numbers as the state.
    """
    from lanewise.operators.tracking import walked, walked_schema

    spans = list(skip or [])

    def step(state: list, row: dict) -> list[tuple]:
        now = affine.product(state[0], row["map"])
        if is_anchor(row["frame_index"], every, spans):
            state[0] = now
        return [(row["frame_index"], now)]

    schema = walked_schema(steps, video, [("frame_index", "long"), ("map", "array<double>")])
    return walked(steps.select(video, "frame_index", "map"), video, "frame_index", schema, lambda: [list(affine.SAME)], step)
