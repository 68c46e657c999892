"""Queries on many videos: trackers, maps between planes and clocks, driving lines from labels, detector outputs, rasters, result tables."""
from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanewise.functions import affine, geometry as G, heads
from lanewise.operators import connection as C, graphs, matching as M, raster, relational as R, roads, tracking as K
from lanewise.plans import roads as road_plans, tracks, views as V
from lanewise.sources import annotations as A

# ---- trackers


def deep_sort_tracks(spark, sf_dir):
    """Motion and appearance; a vehicle's feature is a place on the circle."""
    b = tracks.video_boxes(spark, sf_dir, turned=False)
    b = b.withColumn("feature", F.array(F.cos(F.col("veh_id") * 1.0), F.sin(F.col("veh_id") * 1.0)))
    out = K.track(b, method="deep_sort", feature="feature", max_age=5, min_hits=2)
    return out.groupBy("video_id", "track_id").agg(F.count("*").alias("n"), F.min("frame_index").alias("first"), F.max("frame_index").alias("last"))


def turned_sort_tracks(spark, sf_dir):
    out = K.track(tracks.video_boxes(spark, sf_dir, turned=True), method="sort_turned", max_age=5)
    return out.groupBy("video_id", "track_id").agg(F.count("*").alias("n"), F.min("frame_index").alias("first"), F.max("frame_index").alias("last"))


def _turned(spark, sf_dir):
    """Boxes turned by quarters, so that their overlap is that of upright ones."""
    return V.boxes(spark, sf_dir).withColumn("theta", (F.col("det_id") % 2) * (math.pi / 2))


def turned_overlaps(spark, sf_dir):
    return M.turned_pairs(_turned(spark, sf_dir), "frame_index").select("frame_index", "a", "b", F.round(F.col("iou") + 1e-9, 6).alias("iou")).filter("iou > 0")


def gate_by_height(spark, sf_dir):
    """Squared distance of each measurement to what the filter by height expects, and whether it passes the gate."""
    p = V.points(spark, sf_dir).select("veh_id", "frame_index", "x", "y", (F.col("y") / 50 + 0.5).alias("aspect"), (F.col("x") / 4 + 20).alias("height"))
    out = K.gated_by_height(p, "veh_id", "frame_index", ["x", "y", "aspect", "height"])
    return out.select("veh_id", "frame_index", F.round("d2", 3).alias("d2"), (F.round("d2", 3) <= K.GATE[4]).alias("passes"))


def nms_plus(spark, sf_dir):
    """Suppression where a side counts a pixel more than its difference."""
    return M.non_maximum(V.boxes(spark, sf_dir), "frame_index", "score", 0.2, plus=1.0)


# ---- maps and clocks


def _steps(spark, sf_dir):
    p = V.points(spark, sf_dir)
    turn = (F.col("frame_index") % 7) * 0.01
    return p.select("veh_id", "frame_index", F.array(F.cos(turn), -F.sin(turn), F.col("x") / 100, F.sin(turn), F.cos(turn), F.col("y") / 100).alias("map"))


def cumulative_maps(spark, sf_dir):
    """Each frame's map to its video's first, re-anchored at every third frame outside a span."""
    out = C.cumulated(_steps(spark, sf_dir), "veh_id", 3, [(60, 90)])
    m = affine.parts(F.col("map"))
    return out.select("veh_id", "frame_index", *[F.round(m[i], 4).alias(n) for i, n in ((0, "a"), (2, "tx"), (5, "ty"))])


def _nodes(spark, sf_dir):
    n = F.col("src")
    edge = F.array(1 + n / 100, n / 200, n * 1.0, -n / 200, 1 - n / 100, n * -2.0)
    return graphs.paths_to_root(V.graph(spark, sf_dir).withColumns({"shift": n * 2.0, "map": edge}), 0)


def node_alignment(spark, sf_dir):
    """Vehicles of 25 videos in the plane and the frame numbers of the main one."""
    p = V.points(spark, sf_dir).withColumn("video_id", (F.col("veh_id") % 25).cast("int"))
    own = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("video_id"), F.lit(0).alias("first_frame"), (F.col("n_nationkey") * 100.0).alias("start_ms"), F.lit(40.0).alias("delta_ms"))
    out = C.aligned(p, _nodes(spark, sf_dir), own, own.filter("video_id = 0"))
    return out.select("veh_id", "frame_raw", "frame_index", F.round(F.col("x") + 3.3e-9, 4).alias("x"), F.round(F.col("y") + 3.3e-9, 4).alias("y"))


def mapped_lines(spark, sf_dir):
    """Driving lines of suppliers' roads in the plane of the main video, through the map of their nation's video."""
    k = F.col("s_suppkey")
    points = F.array(*[G.point(F.lit(x) + k % 7, F.lit(y) - k % 5) for x, y in V.LINE])
    lines = V.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("int").alias("video_id"), k.alias("line"), points.alias("points"))
    out = C.mapped_lines(lines, _nodes(spark, sf_dir).select(F.col("node").cast("int").alias("video_id"), "map"), ["video_id"])
    return out.select("line", F.posexplode("points").alias("i", "p")).select("line", "i", F.round(F.col("p.x") + 3.3e-9, 4).alias("x"), F.round(F.col("p.y") + 3.3e-9, 4).alias("y"))


def similarity_fits(spark, sf_dir):
    """The turn, scale and shift of each lane's places that comes nearest to their mirror on a grid."""
    u, v = F.col("x") * 2 - F.col("y") + 5, F.col("x") + 2 * F.col("y") - F.col("frame_index") % 3
    fit = V.points(spark, sf_dir).groupBy("lane_id").agg(affine.similarity_fit(F.col("x"), F.col("y"), u, v).alias("m"))
    return fit.select("lane_id", *[F.round(c, 3).alias(n) for n, c in zip(("a", "b", "tx", "c", "d", "ty"), affine.parts(F.col("m")), strict=True)])


def offset_clock(spark, sf_dir):
    return V.points(spark, sf_dir).select("veh_id", "frame_index", F.round(A.offset_ms(F.lit(1000), F.col("frame_index"), F.lit(24)), 4).alias("unix_ms"))


def _edge_sides(spark, sf_dir):
    """Even and odd vehicles of an edge, as the main and the sub side; sixteen vehicles make an edge."""
    p = V.points(spark, sf_dir).withColumn("edge", F.floor(F.col("veh_id") / 16))
    return p.filter("veh_id % 2 = 0").withColumnRenamed("veh_id", "a"), p.filter("veh_id % 2 = 1").withColumnRenamed("veh_id", "b")


def offset_matching(spark, sf_dir):
    """The offset of each edge at which its vehicles match best."""
    best = C.best_offsets(C.offset_quality(*_edge_sides(spark, sf_dir), radius=1))
    return best.select("edge", "offset", "n", F.round("mean", 4).alias("mean"))


def edge_parameters(spark, sf_dir):
    """Map, numbering, horizon and matching of each edge; number and mean of what is accepted."""
    a, b = _edge_sides(spark, sf_dir)
    edges = a.select("edge").distinct().withColumn("map", F.array(*[F.lit(v) for v in (1.0, 0.0, 2.0, 0.0, 1.0, -1.0)]))
    clock = edges.select("edge", F.lit(0).alias("first_frame"), F.lit(0.0).alias("start_ms"), F.lit(40.0).alias("delta_ms"), F.lit(0.0).alias("offset"))
    out = C.edge_matches(a, b, edges, clock, clock)["quality"]
    return out.select("edge", "n", F.round("mean", 4).alias("mean"))


def match_tables(spark, sf_dir):
    """Ids of near pairs and of far pairs of each frame, as lists in text."""
    near = tracks.costs(spark, sf_dir).filter("abs(a - b) = 1 and a < b").withColumn("edge", F.col("frame_index"))
    split = M.split_by_distance(near, 50.0)
    rest = V.boxes(spark, sf_dir).filter("det_id % 2 = 1").select(F.col("frame_index").alias("edge"), F.col("det_id").alias("a")).join(near.select("edge", "a"), ["edge", "a"], "left_anti")
    t = C.match_tables(split, rest, rest.filter("false").withColumnRenamed("a", "b"))
    kinds = [df.select("edge", F.lit(kind).alias("kind"), "main_ids", "sub_ids") for kind, df in t.items()]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def near_horizon(spark, sf_dir):
    """Vehicles whose first or last frame is in a span."""
    return C.touching_horizon(V.points(spark, sf_dir), ["veh_id"], 2, 40).groupBy("veh_id").agg(F.count("*").alias("n"))


def first_fit(spark, sf_dir):
    """Clusters by one pass over the pairs of each order's boxes."""
    near = R.pairs_in_frame(V.boxes(spark, sf_dir)).withColumn("at", F.col("a") * 10 + F.col("b"))
    return graphs.first_fit_clusters(near, "at", "frame_index").groupBy("frame_index").agg(F.count("*").alias("members"), F.countDistinct("cluster_no").alias("clusters"))


# ---- sources


def _parts(spark, sf_dir):
    k = F.col("s_suppkey")
    return V.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("video_id"), k.alias("part_no"), (k % 50 + 10).alias("frames"), (k % 3 * 5 + 20).alias("fps"))


def seek(spark, sf_dir):
    seconds = _parts(spark, sf_dir).select("video_id").distinct().withColumn("seconds", F.explode(F.array(*[F.lit(v) for v in (0.0, 0.5, 1.25, 3.0, 1000000.0)])))
    return A.sought(A.part_spans(_parts(spark, sf_dir)), seconds)


def frame_scan(spark, sf_dir):
    """Every second frame of each video without its first 5 and last 7."""
    return A.frames_of(A.part_spans(_parts(spark, sf_dir)), F.lit(5), F.lit(7), F.lit(2))


def _labels(spark, sf_dir):
    """A chain of positions for each region: the first nation holds the base; each links to the next."""
    n, w = F.col("n_nationkey"), Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    t = V.table(spark, sf_dir, "nation").withColumns({"after": F.lead("n_nationkey").over(w), "before": F.lag("n_nationkey").over(w)})
    line = F.concat(F.lit("drivingline_r"), F.col("n_regionkey"), F.lit("_"), n)
    pt = lambda x, y: G.point(x, y)
    shape = lambda what, points, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.concat(line, F.lit("_"), what).alias("label"), points.alias("points")))
    link = lambda p, q: F.concat(F.lit("connect_"), p.cast("string"), F.lit("_"), q.cast("string"))
    shapes = F.array(
        shape(F.lit("line"), F.array(pt(F.lit(0.0), F.lit(0.0)), pt(F.lit(100.0), F.lit(0.0)), pt(F.lit(100.0), 50 + n))),
        shape(F.lit("region"), F.array(pt(F.lit(-5.0), F.lit(-5.0)), pt(F.lit(120.0), F.lit(-5.0)), pt(F.lit(120.0), F.lit(60.0)), pt(F.lit(-5.0), F.lit(60.0))), n % 2 == 0),
        shape(F.lit("point_100"), F.array(pt(F.lit(10.0), F.lit(3.0))), F.col("before").isNull()),
        shape(link(n, F.col("after")), F.array(pt(F.lit(90.0), F.lit(2.0))), F.col("after").isNotNull()),
        shape(link(F.col("before"), n), F.array(pt(F.lit(5.0), F.lit(1.0))), F.col("before").isNotNull()),
    )
    return t.select(F.posexplode(F.array_compact(shapes)).alias("shape_no", "s")).select("shape_no", "s.label", "s.points")


def driving_tables(spark, sf_dir):
    d = roads.driving_lines(_labels(spark, sf_dir))
    return d.select("line", "position", F.size("points").alias("n_points"), F.col("region").isNotNull().alias("has_region"), "base_x", "base_distance", F.size("connects").alias("links"))


def region_distance(spark, sf_dir):
    """Distances of vehicles along a chain of driving lines, by position; none outside a position's region."""
    lines = roads.driving_lines(_labels(spark, sf_dir))
    bases = roads.line_bases(lines, lines.select("position").distinct().withColumn("per_pixel", F.lit(0.5)))
    nation = V.table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("line"), F.col("n_nationkey").cast("string").alias("position"))
    p = V.points(spark, sf_dir).withColumn("position", (F.col("veh_id") % 25).cast("string")).join(nation, "position")
    out = roads.on_driving_lines(p, bases)
    return out.select("veh_id", "frame_index", F.round("line_pos", 4).alias("line_pos"), F.round("line_offset", 4).alias("line_offset"))


def calibration(spark, sf_dir):
    k = F.col("p_partkey")
    shapes = V.table(spark, sf_dir, "part").select((k % 40).alias("scene"), k.alias("shape_no"), F.concat(F.lit("stitch_"), (k % 3).cast("string"), (k % 5).cast("string")).alias("label"), F.array(G.point(k, k * 2)).alias("points"))
    return roads.calibration_points(shapes, ["scene"], "stitch_1").select("scene", F.get("points", F.lit(0)).x.alias("x"))


def road_settings(spark, sf_dir):
    """Scale, lanes and axis of each supplier's annotated road."""
    k = F.col("s_suppkey")
    ring = F.array(G.point(k, k), G.point(k + 9.7, k), G.point(k + 9.7, k + 5))
    axis = [G.point(k, F.lit(1.0)), G.point(k + 30, F.lit(41.0)), G.point(k + 10, F.lit(90.0))]
    rows = [("road", ring), ("fp", ring), ("lane_1", ring), ("lane_2", ring), ("length_10", F.array(axis[0], axis[1])), ("length_4", F.array(axis[0], axis[2])), ("x", F.array(axis[0], axis[1])), ("y", F.array(axis[2]))]
    shapes = F.array(*[F.struct(F.lit(n).alias("label"), p.alias("points")) for n, p in rows])
    t = V.table(spark, sf_dir, "supplier").select(k.alias("path"), F.posexplode(shapes).alias("shape_no", "s")).select("path", "shape_no", "s.label", "s.points")
    o = roads.road_settings(t)
    return o.select("path", F.size("lanes").alias("lanes"), F.round("per_pixel", 6).alias("per_pixel"), F.col("x_vector.x").alias("vx"), F.round("y_vector.x", 4).alias("wx"), F.round("y_vector.y", 4).alias("wy"), F.get(F.get("road", F.lit(0)), F.lit(1)).x.alias("corner"))


# ---- boxes and lists


def centre_decode(spark, sf_dir):
    """Corners from the outputs at each cell: turned figures where the class of turning is sure, else upright ones."""
    v = F.col("v").cast("double")
    wh = [v * k / 10 for k in (-1, -2, 3, -1, 1, 2, -3, 1, 6, 4)]
    out = heads.centre_head(F.col("x") + v / 100, F.col("y") + v / 200, wh, F.col("cell") % 10 / 10, F.lit(4.0), F.lit(3.0))
    return V.heat(spark, sf_dir).select("cell", *[F.round(c, 4).alias(n) for n, c in out.items()])


def _figure(spark, sf_dir):
    b = V.boxes(spark, sf_dir).withColumn("theta", (F.col("det_id") * 0.7) % math.pi)
    return b, G.corners(*[F.col(n) for n in ("cx", "cy", "w", "h", "theta")])


def least_rectangles(spark, sf_dir):
    """Boxes found again from their corners."""
    b, c = _figure(spark, sf_dir)
    r = b.select("frame_index", "det_id", heads.least_rectangle(c).alias("r"))
    return r.select("frame_index", "det_id", F.round("r.cx", 4).alias("cx"), F.round("r.cy", 4).alias("cy"), F.round(F.greatest("r.w", "r.h"), 4).alias("long"), F.round(F.least("r.w", "r.h"), 4).alias("short"))


def hull_rectangles(spark, sf_dir):
    """Area of the least rectangle around the centres and corners of an order's boxes, and the figure's share of it."""
    b = V.boxes(spark, sf_dir).groupBy("frame_index").agg(F.flatten(F.collect_list(F.array(G.point(F.col("cx"), F.col("cy")), G.point(F.col("l"), F.col("b"))))).alias("points"))
    out = b.select("frame_index", heads.least_rectangle_of(F.col("points")).alias("r"))
    return out.select("frame_index", F.round(F.col("r.w") * F.col("r.h") + 3.3e-9, 4).alias("area"))


def full_boxes(spark, sf_dir):
    """Mean corner, and the first corner of the figure or of its bounds where it fills them."""
    b, c = _figure(spark, sf_dir)
    x, y = heads.corner_mean(c)
    u = heads.upright_if_full(c)
    return b.select("frame_index", "det_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(u[0], 4).alias("x1"), F.round(u[1], 4).alias("y1"))


def box_codecs(spark, sf_dir):
    """Forms of upright boxes and back, and boxes clipped to an image."""
    c = F.col
    state = G.to_state(c("l"), c("t"), c("r"), c("b"))
    back = G.from_state(*state.values())
    size = G.to_corner_size(c("cx"), c("cy"), c("w"), c("h"))
    high, cut = G.to_height_form(*size), G.clipped(*size, 190, 120)
    names = {"area": state["area"], "right": back[2], "bottom": back[3], "aspect": high[2], "high": high[3], "x1": cut[0], "y1": cut[1], "x2": cut[2], "y2": cut[3]}
    return V.boxes(spark, sf_dir).select("frame_index", "det_id", *[F.round(v, 5).alias(n) for n, v in names.items()])


def turned_corners(spark, sf_dir):
    """Corners of turned boxes over a score."""
    b, c = _figure(spark, sf_dir)
    return heads.turned_detections(b, 30000.0).select("frame_index", "det_id", *[F.round(F.get("corners", F.lit(i)), 4).alias(n) for i, n in ((0, "x1"), (1, "y1"), (6, "x4"), (7, "y4"))])


def best_of_classes(spark, sf_dir):
    return R.top_over_classes(V.boxes(spark, sf_dir).withColumn("img", F.col("frame_index") % 50), ["img"], "category", "score", 10, ["frame_index", "det_id"]).select("img", "frame_index", "det_id", "category", "rank")


def running_loss(spark, sf_dir):
    p = V.points(spark, sf_dir)
    return p.select("veh_id", "frame_index", F.round(heads.running_mean("x", ["veh_id"], "frame_index"), 9).alias("mean"))


def line_order(spark, sf_dir):
    t = V.table(spark, sf_dir, "part").select(F.concat(F.lit("laneline_"), (F.col("p_partkey") % 97).cast("string"), F.lit("_"), F.col("p_partkey").cast("string")).alias("label"))
    return roads.by_number(t).select("label", "number")


def start_order(spark, sf_dir):
    t = V.points(spark, sf_dir).groupBy("veh_id").agg(F.min("frame_index").alias("first"))
    return R.in_order_of_start(t, "veh_id")


def list_overlap(spark, sf_dir):
    """Orders with a supplier in common with the nations of their part numbers' ends."""
    g = V.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 5).alias("a"), F.collect_set(F.col("l_partkey") % 5).alias("b"))
    return R.overlapping_lists(g, "a", "b").select("l_orderkey")


# ---- rasters


def _pixels(spark, sf_dir):
    return V.heat(spark, sf_dir).withColumn("v", F.when(F.col("v") > 20, F.col("v")).otherwise(0))


def mask_pixels(spark, sf_dir):
    """Pixels inside or on a polygon whose corners are cut to integers."""
    rings = F.array(G.polygon([(2.7, 1.2), (15.9, 1.9), (15.1, 7.8), (2.2, 7.3)]))
    return raster.masked(V.heat(spark, sf_dir), rings).select("img_id", "y", "x", "v")


def warp_pixels(spark, sf_dir):
    """Images moved by half their scale and two pixels, by the nearest source."""
    h = V.heat(spark, sf_dir)
    images = h.select("img_id").distinct()
    maps = images.withColumn("map", F.array(*[F.lit(v) for v in (2.0, 0.0, 2.0, 0.0, 1.0, 1.0)]))
    return raster.warped(h, images.withColumns({"width": F.lit(24), "height": F.lit(11)}), maps, ["img_id"])


#: A map that turns, shears and scales.
TILT = (1.7, 0.25, 2.0, -0.125, 0.9, 1.0)


def warp_smooth(spark, sf_dir):
    """Images turned and scaled, each place mixed of the four pixels around its source; black beyond."""
    h = V.heat(spark, sf_dir)
    images = h.select("img_id").distinct()
    maps = images.withColumn("map", F.array(*[F.lit(v) for v in TILT]))
    out = raster.warped_smoothly(h, images.withColumns({"width": F.lit(36), "height": F.lit(12)}), maps, ["img_id"])
    return out.select("img_id", "y", "x", F.round(F.col("v") + 3.3e-9, 4).alias("v"))


def panorama_pixels(spark, sf_dir):
    return raster.panorama(_pixels(spark, sf_dir).withColumn("scene", F.col("img_id") % 4), ["scene"])


def background_first(spark, sf_dir):
    """Mean of each pixel over the first three images of each scene."""
    h = V.heat(spark, sf_dir).withColumn("scene", F.col("img_id") % 4)
    out = raster.background(h, h, ["scene"], "img_id", 3)
    return out.select("scene", "y", "x", F.round("mean", 4).alias("mean"))


def tile_light(spark, sf_dir):
    """Tiles of 8 by 5 pixels that aren't all but black."""
    p = _pixels(spark, sf_dir)
    images = p.select("img_id").distinct().withColumns({"width": F.lit(20), "height": F.lit(10)})
    tiles = raster.tile_plan(images, 8, 5, 2).withColumn("tile_id", F.col("left_px") * 100 + F.col("up_px")).drop("width", "height")
    return raster.lit_tiles(p, tiles, ["img_id"], 8, 5, 0.4).select("img_id", "tile_id", F.round("black", 4).alias("black"))


def normal_pixels(spark, sf_dir):
    return V.heat(spark, sf_dir).select("cell", F.round(heads.normalised(F.col("v"), 0.485, 0.229), 6).alias("v"))


Q = "WITH " + V.POINTS
_iou = "(greatest(least(p.r, q.r) - greatest(p.l, q.l), 0) * greatest(least(p.b, q.b) - greatest(p.t, q.t), 0))"
_swap = """s AS (SELECT frame_index, det_id, cx - u / 2 AS l, cy - v / 2 AS t, cx + u / 2 AS r, cy + v / 2 AS b FROM (SELECT *, CASE WHEN det_id % 2 = 1 THEN h ELSE w END AS u, CASE WHEN det_id % 2 = 1 THEN w ELSE h END AS v FROM boxes))"""
_parts_sql = "v AS (SELECT s_nationkey AS video_id, s_suppkey AS part_no, s_suppkey % 50 + 10 AS frames, s_suppkey % 3 * 5 + 20 AS fps FROM supplier), sp AS (SELECT *, coalesce(sum(frames) OVER (PARTITION BY video_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, sum(frames) OVER (PARTITION BY video_id)::BIGINT AS total FROM v)"
_fit = "sum(x * x + y * y) - count(*) * (avg(x) * avg(x) + avg(y) * avg(y))"
_rot = "r AS (SELECT *, (det_id * 0.7::DOUBLE) % pi() AS theta FROM boxes)"
_cs = [(a, b) for a, b in ((1, 1), (1, -1), (-1, -1), (-1, 1))]
_cx = [f"(cx + {a} * (w / 2 * cos(theta)) + {b} * (-h / 2 * sin(theta)))" for a, b in _cs]
_cy = [f"(cy + {a} * (w / 2 * sin(theta)) + {b} * (h / 2 * cos(theta)))" for a, b in _cs]
_bounds = f"(greatest({', '.join(_cx)}) - least({', '.join(_cx)})) * (greatest({', '.join(_cy)}) - least({', '.join(_cy)}))"


def _decode_sql() -> str:
    wh = [f"v * {k} / 10" for k in (-1, -2, 3, -1, 1, 2, -3, 1, 6, 4)]
    up = [("0", f"-({wh[9]}) / 2"), (f"({wh[8]}) / 2", "0"), ("0", f"({wh[9]}) / 2"), (f"-({wh[8]}) / 2", "0")]
    pick = lambda i, j: f"CASE WHEN cell % 10 / 10 > 0.8 THEN {wh[2 * i + j]} ELSE {up[i][j]} END"
    out = ["round(px * 4, 4) AS cx", "round(py * 3, 4) AS cy"]
    for k, (p, q) in enumerate(((0, 1), (2, 1), (2, 3), (0, 3)), 1):
        out += [f"round((px + {pick(p, 0)} + {pick(q, 0)}) * 4, 4) AS x{k}", f"round((py + {pick(p, 1)} + {pick(q, 1)}) * 3, 4) AS y{k}"]
    return f"WITH {V.HEAT}, h AS (SELECT cell, v::DOUBLE AS v, x + v / 100 AS px, y + v / 200 AS py FROM heat) SELECT cell, {', '.join(out)} FROM h"


_edge_tree = f"""{V.GRAPH},
e AS (SELECT src, dst, 1 + src / 100 AS a, src / 200 AS b, src::DOUBLE AS tx, -src / 200 AS c, 1 - src / 100 AS d, src * -2::DOUBLE AS ty FROM graph),
walk AS (SELECT 0 AS node, 0::DOUBLE AS shift, 1::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS tx, 0::DOUBLE AS c, 1::DOUBLE AS d, 0::DOUBLE AS ty
  UNION ALL SELECT e.src, shift + e.src * 2::DOUBLE, w.a * e.a + w.b * e.c, w.a * e.b + w.b * e.d, w.a * e.tx + w.b * e.ty + w.tx, w.c * e.a + w.d * e.c, w.c * e.b + w.d * e.d, w.c * e.tx + w.d * e.ty + w.ty
  FROM walk w JOIN e ON e.dst = w.node)"""
_pos = "CASE WHEN dist_y < dist_x THEN 100 + least(greatest(y, 0), 50 + n) ELSE least(greatest(x, 0), 100) END"

QUERIES = {
    "deep_sort_tracks": (deep_sort_tracks, None),
    "turned_sort_tracks": (turned_sort_tracks, None),
    "turned_overlaps": (turned_overlaps, f"WITH {V.BOXES}, {_swap} SELECT * FROM (SELECT p.frame_index, p.det_id AS a, q.det_id AS b, round({_iou} / ((p.r - p.l) * (p.b - p.t) + (q.r - q.l) * (q.b - q.t) - {_iou}) + 1e-9, 6) AS iou FROM s p JOIN s q ON p.frame_index = q.frame_index AND p.det_id < q.det_id) WHERE iou > 0"),
    "gate_by_height": (gate_by_height, road_plans.height_sql(gate=True)),
    "nms_plus": (nms_plus, tracks.suppress_sql("1")),
    "cumulative_maps": (cumulative_maps, f"""WITH RECURSIVE {V.POINTS},
m AS (SELECT veh_id, frame_index, row_number() OVER (PARTITION BY veh_id ORDER BY frame_index) AS n, cos(frame_index % 7 * 0.01::DOUBLE) AS p, sin(frame_index % 7 * 0.01::DOUBLE) AS q, x / 100 AS tx, y / 100 AS ty,
      frame_index % 3 = 0 AND frame_index NOT BETWEEN 60 AND 90 AS anchor FROM points),
k AS (SELECT veh_id, frame_index, n, p AS a, -q AS b, tx, q AS c, p AS d, ty, CASE WHEN anchor THEN p ELSE 1 END AS ka, CASE WHEN anchor THEN -q ELSE 0 END AS kb, CASE WHEN anchor THEN tx ELSE 0 END AS kx,
             CASE WHEN anchor THEN q ELSE 0 END AS kc, CASE WHEN anchor THEN p ELSE 1 END AS kd, CASE WHEN anchor THEN ty ELSE 0 END AS ky FROM m WHERE n = 1
  UNION ALL SELECT veh_id, frame_index, n, a, b, tx, c, d, ty, CASE WHEN anchor THEN a ELSE ka END, CASE WHEN anchor THEN b ELSE kb END, CASE WHEN anchor THEN tx ELSE kx END, CASE WHEN anchor THEN c ELSE kc END, CASE WHEN anchor THEN d ELSE kd END, CASE WHEN anchor THEN ty ELSE ky END
  FROM (SELECT m.veh_id, m.frame_index, m.n, m.anchor, ka * p + kb * q AS a, kb * p - ka * q AS b, ka * m.tx + kb * m.ty + kx AS tx, kc * p + kd * q AS c, kd * p - kc * q AS d, kc * m.tx + kd * m.ty + ky AS ty, ka, kb, kx, kc, kd, ky FROM k JOIN m ON m.veh_id = k.veh_id AND m.n = k.n + 1))
SELECT veh_id, frame_index, round(a, 4) AS a, round(tx, 4) AS tx, round(ty, 4) AS ty FROM k"""),
    "node_alignment": (node_alignment, f"""WITH RECURSIVE {V.POINTS}, {_edge_tree}
SELECT veh_id, frame_index AS frame_raw, round_even((frame_index * 40 + veh_id % 25 * 100 + shift * 40) / 40, 0)::BIGINT AS frame_index, round(a * x + b * y + tx + 3.3e-9, 4) AS x, round(c * x + d * y + ty + 3.3e-9, 4) AS y FROM points JOIN walk ON node = veh_id % 25"""),
    "mapped_lines": (mapped_lines, f"""WITH RECURSIVE {_edge_tree}
SELECT s_suppkey AS line, i::INTEGER AS i, round(a * (px + s_suppkey % 7) + b * (py - s_suppkey % 5) + tx + 3.3e-9, 4) AS x, round(c * (px + s_suppkey % 7) + d * (py - s_suppkey % 5) + ty + 3.3e-9, 4) AS y
FROM supplier JOIN walk ON node = s_nationkey, (VALUES {", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(V.LINE))}) AS p(i, px, py)"""),
    "similarity_fits": (similarity_fits, f"""{Q}, p AS (SELECT lane_id, x, y, x * 2 - y + 5 AS u, x + 2 * y - frame_index % 3 AS v FROM points),
s AS (SELECT lane_id, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, {_fit} AS n, sum(x * u + y * v) - count(*) * (avg(x) * avg(u) + avg(y) * avg(v)) AS p, sum(x * v - y * u) - count(*) * (avg(x) * avg(v) - avg(y) * avg(u)) AS q FROM p GROUP BY 1 HAVING count(*) > 1)
SELECT lane_id, round(p / n, 3) AS a, round(-q / n, 3) AS b, round(mu - p / n * mx + q / n * my, 3) AS tx, round(q / n, 3) AS c, round(p / n, 3) AS d, round(mv - q / n * mx - p / n * my, 3) AS ty FROM s"""),
    "offset_clock": (offset_clock, f"{Q} SELECT veh_id, frame_index, round(1000 + frame_index * (1000 / 24), 4) AS unix_ms FROM points"),
    "offset_matching": (offset_matching, None),
    "edge_parameters": (edge_parameters, None),
    "match_tables": (match_tables, f"""WITH {V.BOXES}, n AS (SELECT p.frame_index AS edge, p.det_id AS a, q.det_id AS b, sqrt((p.cx - q.cx) ** 2 + (p.cy - q.cy) ** 2) < 50 AS ok FROM boxes p JOIN boxes q ON p.frame_index = q.frame_index AND p.det_id % 2 = 1 AND q.det_id = p.det_id + 1)
SELECT edge, CASE WHEN ok THEN 'match_' ELSE 'not_match_' END AS kind, string_agg(a::VARCHAR, ';' ORDER BY a) AS main_ids, string_agg(b::VARCHAR, ';' ORDER BY a) AS sub_ids FROM n GROUP BY edge, ok
UNION ALL SELECT frame_index, 'not_match_single_', string_agg(det_id::VARCHAR, ';' ORDER BY det_id), NULL FROM boxes WHERE det_id % 2 = 1 AND (frame_index, det_id) NOT IN (SELECT (edge, a) FROM n) GROUP BY 1"""),
    "near_horizon": (near_horizon, f"{Q} SELECT veh_id, count(*) AS n FROM points GROUP BY veh_id HAVING min(frame_index) BETWEEN 2 AND 40 OR max(frame_index) BETWEEN 2 AND 40"),
    "first_fit": (first_fit, None),
    "seek": (seek, f"WITH {_parts_sql}, f AS (SELECT video_id, arg_min(fps, part_no) AS fps FROM v GROUP BY 1) SELECT sp.video_id, s.seconds, part_no, (floor(s.seconds * f.fps) - before)::BIGINT AS frame FROM sp JOIN f USING (video_id), (VALUES (0::DOUBLE), (0.5), (1.25), (3.0), (1000000.0)) AS s(seconds) WHERE floor(s.seconds * f.fps) >= before AND floor(s.seconds * f.fps) < before + frames"),
    "frame_scan": (frame_scan, f"WITH {_parts_sql} SELECT video_id, part_no, before + i AS frame_index, i::INTEGER AS frame FROM sp, range(0, 60) AS r(i) WHERE i < frames AND before + i >= 5 AND before + i < total - 7 AND (before + i) % 2 = 0"),
    "driving_tables": (driving_tables, """SELECT 'r' || n_regionkey AS line, n_nationkey::VARCHAR AS position, 3 AS n_points, n_nationkey % 2 = 0 AS has_region, CASE WHEN lag(n_nationkey) OVER w IS NULL THEN 10::DOUBLE END AS base_x, CASE WHEN lag(n_nationkey) OVER w IS NULL THEN 100::DOUBLE END AS base_distance,
  (lag(n_nationkey) OVER w IS NOT NULL)::INTEGER + (lead(n_nationkey) OVER w IS NOT NULL)::INTEGER AS links FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)"""),
    "region_distance": (region_distance, f"""{Q}, b AS (SELECT n_nationkey AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation),
p AS (SELECT veh_id, frame_index, x, y, n, k, sqrt((x - greatest(0, least(x, 100))) ** 2 + y ** 2) AS dist_x, sqrt((x - 100) ** 2 + (y - greatest(0, least(y, 50 + n))) ** 2) AS dist_y FROM points JOIN b ON n = veh_id % 25)
SELECT veh_id, frame_index, CASE WHEN n % 2 = 1 OR (x > -5 AND x < 120 AND y > -5 AND y < 60) THEN round(({_pos} - CASE WHEN k = 1 THEN 10 ELSE 5 END) * 0.5::DOUBLE + 100 + CASE WHEN k = 1 THEN 0 ELSE 40 + (k - 2) * 42.5::DOUBLE END, 4) END AS line_pos,
       CASE WHEN n % 2 = 1 OR (x > -5 AND x < 120 AND y > -5 AND y < 60) THEN round(least(dist_x, dist_y) * 0.5::DOUBLE, 4) END AS line_offset FROM p"""),
    "calibration": (calibration, "SELECT p_partkey % 40 AS scene, min(p_partkey)::DOUBLE AS x FROM part WHERE p_partkey % 3 = 1 GROUP BY 1"),
    "road_settings": (road_settings, "SELECT s_suppkey AS path, 2 AS lanes, round((10 / 50::DOUBLE + 4 / sqrt(100 + 89 * 89::DOUBLE)) / 2, 6) AS per_pixel, 30::DOUBLE AS vx, round(10 - 30 * (10 * 30 + 89 * 40) / 2500::DOUBLE, 4) AS wx, round(89 - 40 * (10 * 30 + 89 * 40) / 2500::DOUBLE, 4) AS wy, (s_suppkey + 9)::DOUBLE AS corner FROM supplier"),
    "centre_decode": (centre_decode, _decode_sql()),
    "least_rectangles": (least_rectangles, f"WITH {V.BOXES} SELECT frame_index, det_id, round(cx, 4) AS cx, round(cy, 4) AS cy, round(greatest(w, h), 4) AS long, round(least(w, h), 4) AS short FROM boxes"),
    "hull_rectangles": (hull_rectangles, f"""WITH {V.BOXES}, p AS (SELECT DISTINCT frame_index, x, y FROM (SELECT frame_index, cx AS x, cy AS y FROM boxes UNION ALL SELECT frame_index, l, b FROM boxes)),
d AS (SELECT DISTINCT p.frame_index, (q.x - p.x) / sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS u, (q.y - p.y) / sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS w FROM p JOIN p q ON p.frame_index = q.frame_index AND (p.x < q.x OR (p.x = q.x AND p.y < q.y)))
SELECT frame_index, round(min(area) + 3.3e-9, 4) AS area FROM (SELECT frame_index, u, w, (max(x * u + y * w) - min(x * u + y * w)) * (max(y * u - x * w) - min(y * u - x * w)) AS area FROM d JOIN p USING (frame_index) GROUP BY ALL) GROUP BY 1"""),
    "full_boxes": (full_boxes, f"WITH {V.BOXES}, {_rot} SELECT frame_index, det_id, round(cx, 4) AS x, round(cy, 4) AS y, round(CASE WHEN w * h / ({_bounds}) > 0.9 THEN greatest({', '.join(_cx)}) ELSE {_cx[0]} END, 4) AS x1, round(CASE WHEN w * h / ({_bounds}) > 0.9 THEN least({', '.join(_cy)}) ELSE {_cy[0]} END, 4) AS y1 FROM r"),
    "box_codecs": (box_codecs, f"WITH {V.BOXES} SELECT frame_index, det_id, round(w * h, 5) AS area, round(r, 5) AS right, round(b, 5) AS bottom, round(w / h, 5) AS aspect, round(h, 5) AS high, greatest(trunc(l)::INTEGER, 0) AS x1, greatest(trunc(t)::INTEGER, 0) AS y1, least(trunc(r)::INTEGER, 189) AS x2, least(trunc(b)::INTEGER, 119) AS y2 FROM boxes"),
    "turned_corners": (turned_corners, f"WITH {V.BOXES}, {_rot} SELECT frame_index, det_id, round({_cx[0]}, 4) AS x1, round({_cy[0]}, 4) AS y1, round({_cx[3]}, 4) AS x4, round({_cy[3]}, 4) AS y4 FROM r WHERE score > 30000"),
    "best_of_classes": (best_of_classes, f"WITH {V.BOXES} SELECT * FROM (SELECT frame_index % 50 AS img, frame_index, det_id, category, row_number() OVER (PARTITION BY frame_index % 50 ORDER BY score DESC, frame_index, det_id)::INTEGER AS rank FROM boxes) WHERE rank <= 10"),
    "running_loss": (running_loss, f"{Q} SELECT veh_id, frame_index, round(avg(x) OVER (PARTITION BY veh_id ORDER BY frame_index), 9) AS mean FROM points"),
    "line_order": (line_order, "SELECT 'laneline_' || (p_partkey % 97) || '_' || p_partkey AS label, p_partkey::INTEGER AS number FROM part"),
    "start_order": (start_order, f"{Q} SELECT veh_id, min(frame_index) AS first FROM points GROUP BY veh_id"),
    "list_overlap": (list_overlap, "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING list_has_any(list(l_suppkey % 5), list(l_partkey % 5))"),
    "mask_pixels": (mask_pixels, f"WITH {V.HEAT} SELECT img_id, y, x, v FROM heat WHERE x BETWEEN 2 AND 15 AND y BETWEEN 1 AND 7"),
    "warp_pixels": (warp_pixels, f"WITH {V.HEAT}, t AS (SELECT DISTINCT img_id, i AS x, j AS y FROM heat, range(0, 24) AS a(i), range(0, 11) AS b(j)) SELECT t.img_id, t.y::INTEGER AS y, t.x::INTEGER AS x, h.v FROM t JOIN heat h ON h.img_id = t.img_id AND h.x = floor((t.x - 2) / 2 + 0.5) AND h.y = t.y - 1"),
    "warp_smooth": (warp_smooth, f"""WITH {V.HEAT}, k AS (SELECT {", ".join(f"{v!r}::DOUBLE AS {n}" for n, v in zip(("a", "b", "tx", "c", "d", "ty"), TILT, strict=True))}), i AS (SELECT d / (a * d - b * c) AS ia, -b / (a * d - b * c) AS ib, (b * ty - d * tx) / (a * d - b * c) AS ix, -c / (a * d - b * c) AS ic, a / (a * d - b * c) AS id, (c * tx - a * ty) / (a * d - b * c) AS iy FROM k),
t AS (SELECT img_id, x, y, ia * x + ib * y + ix AS sx, ic * x + id * y + iy AS sy FROM (SELECT DISTINCT img_id FROM heat), range(0, 36) AS p(x), range(0, 12) AS q(y), i),
n AS (SELECT t.img_id, t.x, t.y, floor(sx) + u AS hx, floor(sy) + w AS hy, CASE u WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END * CASE w WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END AS share FROM t, (VALUES (0), (1)) AS e(u), (VALUES (0), (1)) AS f(w))
SELECT n.img_id, n.y::INTEGER AS y, n.x::INTEGER AS x, round(sum(coalesce(h.v, 0) * share) + 3.3e-9, 4) AS v FROM n LEFT JOIN heat h ON h.img_id = n.img_id AND h.x = hx AND h.y = hy GROUP BY 1, 2, 3"""),
    "panorama_pixels": (panorama_pixels, f"WITH {V.HEAT}, m AS (SELECT img_id % 4 AS scene, y, x, max(CASE WHEN v > 20 THEN v ELSE 0 END) AS v FROM heat GROUP BY 1, 2, 3), e AS (SELECT scene, max(y) FILTER (v > 0) AS ty, max(x) FILTER (v > 0) AS tx FROM m GROUP BY 1) SELECT m.* FROM m JOIN e USING (scene) WHERE y <= ty AND x <= tx"),
    "background_first": (background_first, f"WITH {V.HEAT}, f AS (SELECT img_id, row_number() OVER (PARTITION BY img_id % 4 ORDER BY img_id) AS k FROM (SELECT DISTINCT img_id FROM heat)) SELECT img_id % 4 AS scene, y, x, round(avg(v), 4) AS mean FROM heat JOIN f USING (img_id) WHERE k <= 3 GROUP BY 1, 2, 3"),
    "tile_light": (tile_light, f"WITH {V.HEAT}, t AS (SELECT l, u FROM (VALUES (0), (6), (12)) AS a(l), (VALUES (0), (3), (5)) AS b(u)) SELECT img_id, l * 100 + u AS tile_id, round(avg((v <= 20)::INTEGER), 4) AS black FROM heat JOIN t ON x BETWEEN l AND l + 7 AND y BETWEEN u AND u + 4 GROUP BY 1, 2 HAVING avg((v <= 20)::INTEGER) <= 0.4"),
    "normal_pixels": (normal_pixels, f"WITH {V.HEAT} SELECT cell, round((v / 255 - 0.485::DOUBLE) / 0.229::DOUBLE, 6) AS v FROM heat"),
}
