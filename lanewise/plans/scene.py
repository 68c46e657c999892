"""Queries on boxes, places and lanes."""
from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanewise.functions import geometry as G
from lanewise.operators import raster, relational as R
from lanewise.plans import views as V

D = "{}::DOUBLE".format


def _metres_sql() -> tuple[str, str]:
    (ox, oy), (ax, ay), (bx, by), lpp = V.AXIS["origin"], V.AXIS["x_axis"], V.AXIS["y_axis"], V.AXIS["per_pixel"]
    n = math.hypot(ax - ox, ay - oy)
    ux, uy = (ax - ox) / n, (ay - oy) / n
    s = 1.0 if ux * (by - oy) - uy * (bx - ox) >= 0 else -1.0
    return f"{D(lpp)} * ((x - {D(ox)}) * {D(ux)} + (y - {D(oy)}) * {D(uy)})", f"{D(lpp)} * {D(s)} * ((y - {D(oy)}) * {D(ux)} - (x - {D(ox)}) * {D(uy)})"


def on_lanes(spark, sf_dir):
    return R.lane_of(V.points(spark, sf_dir), V.LANES)


def lane_traffic(spark, sf_dir):
    """Flagship: points in metres on lanes; observations, vehicles, and mean place of each lane."""
    mx, my = G.metres(F.col("x"), F.col("y"), **V.AXIS)
    placed = on_lanes(spark, sf_dir).withColumns({"mx": F.round(mx, 4), "my": F.round(my, 4)})
    return placed.groupBy("lane").agg(F.count("*").alias("n"), F.countDistinct("veh_id").alias("vehicles"), F.round(F.sum("mx"), 2).alias("sum_x"), F.round(F.avg("my"), 3).alias("mean_y"))


def in_polygon_lane(spark, sf_dir):
    return on_lanes(spark, sf_dir).select("veh_id", "frame_index", "lane")


def pixel_to_xy(spark, sf_dir):
    mx, my = G.metres(F.col("x"), F.col("y"), **V.AXIS)
    return V.points(spark, sf_dir).select("veh_id", "frame_index", F.round(mx, 4).alias("mx"), F.round(my, 4).alias("my"))


def frame_sample(spark, sf_dir):
    """Every gap-th frame, absolute; gap is 30 / 8 frames a second, rounded half to even."""
    return V.points(spark, sf_dir).filter(R.every_nth(F.col("frame_index"), 30, 8)).select("veh_id", "frame_index")


def length_per_pixel(spark, sf_dir):
    """Mean of metres by pixels over annotated lines, a scale for each scene."""
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("scene"), F.hypot((F.col("s_suppkey") % 97 + 3).cast("double"), (F.col("s_suppkey") % 31).cast("double")).alias("px"), (F.col("s_suppkey") % 17 + 1).alias("m"))
    return s.groupBy("scene").agg(F.round(F.avg(F.col("m") / F.col("px")), 6).alias("per_pixel"), F.count("*").alias("lines"))


def foot_points(spark, sf_dir):
    x, y = G.foot_point(F.col("x"), F.col("y"), F.lit(12.0), F.lit(7.0), F.lit(90.0), F.lit(33.0))
    return V.points(spark, sf_dir).select("veh_id", "frame_index", F.round(x, 5).alias("foot_x"), F.round(y, 5).alias("foot_y"))


def affine_from_three(spark, sf_dir):
    """The map of a vehicle's first three places onto three fixed ones, for vehicles whose places span a plane."""
    w = Window.partitionBy("veh_id").orderBy("frame_index")
    first = V.points(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n <= 3")
    three = first.groupBy("veh_id").agg(*[F.max(F.when(F.col("n") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2, 3) for c in ("x", "y")], F.count("*").alias("k")).filter("k = 3")
    m = G.solve_affine([(F.col(f"x{i}"), F.col(f"y{i}")) for i in (1, 2, 3)], [(F.lit(0.0), F.lit(0.0)), (F.lit(100.0), F.lit(0.0)), (F.lit(0.0), F.lit(50.0))])
    area = (F.col("x1") * (F.col("y2") - F.col("y3")) + F.col("x2") * (F.col("y3") - F.col("y1")) + F.col("x3") * (F.col("y1") - F.col("y2")))
    return three.filter(F.abs(area) > 100).select("veh_id", *[F.round(v, 4).alias(n) for n, v in zip(("a", "b", "tx", "c", "d", "ty"), m, strict=True)])


def box_forms(spark, sf_dir):
    """Rotated boxes by their corners, bounds, long-edge form and (centre, area, ratio) form."""
    theta = (F.col("det_id") * 0.7) % math.pi
    b = V.boxes(spark, sf_dir).withColumn("theta", theta)
    c = G.corners(*[F.col(n) for n in ("cx", "cy", "w", "h", "theta")])
    lo = G.bounds(c)
    long, short, turn = G.long_edge(F.col("h"), F.col("w"), F.col("theta"))
    names = {"x1": c[0], "y1": c[1], "x3": c[4], "y3": c[5], "left": lo[0], "top": lo[1], "right": lo[2], "bottom": lo[3], "long": long, "short": short, "turn": turn, "area": F.col("w") * F.col("h"), "ratio": F.col("w") / F.col("h")}
    return b.select("frame_index", "det_id", *[F.round(v, 4).alias(k) for k, v in names.items()])


def polygon_measures(spark, sf_dir):
    """Area and centre of the four-cornered figure of each box sheared by its category."""
    p = lambda x, y: G.point(F.col(x) + F.col("category") * 2, F.col(y))
    ring = F.array(G.point(F.col("l"), F.col("t")), G.point(F.col("r"), F.col("t")), p("r", "b"), p("l", "b"))
    x, y = G.polygon_centre(ring)
    return V.boxes(spark, sf_dir).select("frame_index", "det_id", F.round(G.polygon_area(ring), 4).alias("area"), x.alias("x"), y.alias("y"))


def _tile_plan(spark, sf_dir):
    """The same six tiles for each nation's video."""
    lefts, ups = R.tile_starts(190, 80, 20), R.tile_starts(120, 70, 20)
    tiles = [F.struct(F.lit(i).alias("tile_id"), F.lit(float(x)).alias("left_px"), F.lit(float(y)).alias("up_px")) for i, (x, y) in enumerate((x, y) for x in lefts for y in ups)]
    return V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("video"), F.explode(F.array(*tiles)).alias("t")).select("video", "t.*")


def tile_detections(spark, sf_dir):
    """Boxes dealt to the tiles of their video that hold them whole, by 3 pixels at least, in the tile's own pixels."""
    boxes = V.boxes(spark, sf_dir).withColumn("video", F.col("frame_index") % 25)
    return raster.retiled(boxes, _tile_plan(spark, sf_dir), ["video"], 80, 70, 3).select("frame_index", "det_id", "tile_id", "tile_x", "tile_y")


def tiles_to_frame(spark, sf_dir):
    """Boxes that a detector saw in a tile, in the pixels of their frame, without those at the tile's border."""
    seen = V.boxes(spark, sf_dir).withColumns({"video": F.col("frame_index") % 25, "tile_id": (F.col("det_id") % 6).cast("int")})
    seen = seen.withColumns({c: F.col(c) - (60.0 if c in "lr" else -10.0) for c in "ltrb"})
    out = raster.framed(seen, _tile_plan(spark, sf_dir), ["video"], 80, 70, 3)
    return out.select("frame_index", "det_id", "tile_id", *[F.round(c, 4).alias(c) for c in "ltrb"])


def tile_plan(spark, sf_dir):
    """Tiles of each image size among suppliers: steps of size less gap, the last moved to the border."""
    sizes = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("video_id"), (640 + F.col("s_suppkey") % 7 * 211).cast("int").alias("width"), (512 + F.col("s_suppkey") % 5 * 97).cast("int").alias("height"))

    return raster.tile_plan(sizes, 640, 512, 100).select("video_id", "left_px", "up_px")


def iou_pairs(spark, sf_dir):
    return R.pairs_in_frame(V.boxes(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


def unique_overlap(spark, sf_dir):
    return R.only_overlaps(R.pairs_in_frame(V.boxes(spark, sf_dir)), 0.3).select("frame_index", "a", "b", F.round("iou", 6).alias("iou"))


def peak_cells(spark, sf_dir):
    return R.peaks(V.heat(spark, sf_dir), ["img_id"])


def top_k(spark, sf_dir):
    """The three best boxes of each frame, and the class that scores best."""
    return R.top_detections(V.boxes(spark, sf_dir), ["frame_index"], "score", 3, ["det_id"]).select("frame_index", "det_id", "category", "score", "rank")


def confidence_filters(spark, sf_dir):
    """How many boxes pass a threshold by > and by >=, a class."""
    b = V.boxes(spark, sf_dir)
    return b.groupBy("category").agg(F.count_if(F.col("score") > 30000).alias("over"), F.count_if(F.col("score") >= 30000).alias("at_least"), F.max_by("det_id", F.struct("score", "frame_index", "det_id")).alias("best"))


def pixel_statistics(spark, sf_dir):
    """Of each image: share of black pixels, bounding box of the others, brightest and mean of the first rows."""
    h = V.heat(spark, sf_dir).withColumn("v", F.when(F.col("v") > 20, F.col("v")).otherwise(0))
    lit = lambda c: F.when(F.col("v") > 0, F.col(c))
    return h.groupBy("img_id").agg(F.round(F.avg((F.col("v") == 0).cast("int")), 4).alias("black"), F.min(lit("x")).alias("left"), F.max(lit("x")).alias("right"), F.min(lit("y")).alias("top"), F.max(lit("y")).alias("bottom"), F.max("v").alias("brightest"))


def background(spark, sf_dir):
    """Mean of each pixel over the first three images, and the greatest over all (a panorama keeps the brighter)."""
    h = V.heat(spark, sf_dir)
    return h.groupBy("y", "x").agg(F.round(F.avg(F.when(F.col("img_id") < 3, F.col("v"))), 4).alias("mean"), F.max("v").alias("top"), F.count("*").alias("n"))


def gate_distance(spark, sf_dir):
    """Squared Mahalanobis distance of successive places for a diagonal covariance; the gate is the 95 % point for two degrees."""
    w = Window.partitionBy("veh_id").orderBy("frame_index")
    p = V.points(spark, sf_dir).withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w)}).filter("dx is not null")
    d = F.round(R.squared_distance([F.col("dx"), F.col("dy")], [F.lit(900), F.lit(400)]), 6)
    return p.select("veh_id", "frame_index", d.alias("d2"), (d <= 5.9915).alias("passes"))


Q = "WITH " + V.POINTS
_mx, _my = _metres_sql()
_xyz = "(x1 * (y2 - y3) + x2 * (y3 - y1) + x3 * (y1 - y2))"
_tiles = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in R.tile_starts(190, 80, 20) for y in R.tile_starts(120, 70, 20))]
_iou = "(greatest(least(p.r, q.r) - greatest(p.l, q.l), 0) * greatest(least(p.b, q.b) - greatest(p.t, q.t), 0))"
_pairs = f"""pairs AS (SELECT frame_index, a, b, inter / (sa + sb - inter) AS iou FROM (
  SELECT p.frame_index, p.det_id AS a, q.det_id AS b, {_iou} AS inter, (p.r - p.l) * (p.b - p.t) AS sa, (q.r - q.l) * (q.b - q.t) AS sb
  FROM boxes p JOIN boxes q ON p.frame_index = q.frame_index AND p.det_id < q.det_id AND p.l < q.r AND q.l < p.r AND p.t < q.b AND q.t < p.b))"""
_rot = "SELECT *, (det_id * 0.7::DOUBLE) % pi() AS theta FROM boxes"
_c = [(a, b) for a, b in ((1, 1), (1, -1), (-1, -1), (-1, 1))]
_cx = [f"cx + {a} * (w / 2 * cos(theta)) + {b} * (-h / 2 * sin(theta))" for a, b in _c]
_cy = [f"cy + {a} * (w / 2 * sin(theta)) + {b} * (h / 2 * cos(theta))" for a, b in _c]
_wrap = lambda t: f"((({t}) + pi() / 2) % pi() + pi()) % pi() - pi() / 2"

QUERIES = {
    "lane_traffic": (lane_traffic, f"{Q}, {V.lanes_sql()}, {V.INSIDE} SELECT lane, count(*) AS n, count(DISTINCT veh_id) AS vehicles, round(sum(round({_mx}, 4)), 2) AS sum_x, round(avg(round({_my}, 4)), 3) AS mean_y FROM placed GROUP BY lane"),
    "in_polygon_lane": (in_polygon_lane, f"{Q}, {V.lanes_sql()}, {V.INSIDE} SELECT veh_id, frame_index, lane FROM placed"),
    "pixel_to_xy": (pixel_to_xy, f"{Q} SELECT veh_id, frame_index, round({_mx}, 4) AS mx, round({_my}, 4) AS my FROM points"),
    "frame_sample": (frame_sample, f"{Q} SELECT veh_id, frame_index FROM points WHERE frame_index % 4 = 0"),
    "length_per_pixel": (length_per_pixel, "SELECT s_nationkey AS scene, round(avg((s_suppkey % 17 + 1) / sqrt(((s_suppkey % 97 + 3) * (s_suppkey % 97 + 3) + (s_suppkey % 31) * (s_suppkey % 31))::DOUBLE)), 6) AS per_pixel, count(*) AS lines FROM supplier GROUP BY 1"),
    "foot_points": (foot_points, f"{Q}, k AS (SELECT *, ((x - 12) * 78 + (y - 7) * 26) / 6760 AS k FROM points) SELECT veh_id, frame_index, round(12 + 78 * k, 5) AS foot_x, round(7 + 26 * k, 5) AS foot_y FROM k"),
    "affine_from_three": (affine_from_three, f"""{Q}, f AS (SELECT *, row_number() OVER (PARTITION BY veh_id ORDER BY frame_index) AS n FROM points),
t AS (SELECT veh_id, {", ".join(f"max(CASE WHEN n = {i} THEN {c} END) AS {c}{i}" for i in (1, 2, 3) for c in "xy")} FROM f WHERE n <= 3 GROUP BY veh_id HAVING count(*) = 3)
SELECT veh_id, round(100 * (y3 - y1) / {_xyz}, 4) AS a, round(100 * (x1 - x3) / {_xyz}, 4) AS b, round(100 * (x3 * y1 - x1 * y3) / {_xyz}, 4) AS tx,
       round(50 * (y1 - y2) / {_xyz}, 4) AS c, round(50 * (x2 - x1) / {_xyz}, 4) AS d, round(50 * (x1 * y2 - x2 * y1) / {_xyz}, 4) AS ty FROM t WHERE abs({_xyz}) > 100"""),
    "box_forms": (box_forms, f"""WITH {V.BOXES}, r0 AS ({_rot}), c AS (SELECT *, {", ".join(f"{x} AS x{i}" for i, x in enumerate(_cx, 1))}, {", ".join(f"{y} AS y{i}" for i, y in enumerate(_cy, 1))} FROM r0)
SELECT frame_index, det_id, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x3, 4) AS x3, round(y3, 4) AS y3, round(least(x1, x2, x3, x4), 4) AS left, round(least(y1, y2, y3, y4), 4) AS top,
       round(greatest(x1, x2, x3, x4), 4) AS right, round(greatest(y1, y2, y3, y4), 4) AS bottom, round(greatest(w, h), 4) AS long, round(least(w, h), 4) AS short,
       round({_wrap("theta + CASE WHEN h < w THEN pi() / 2 ELSE 0 END")}, 4) AS turn, round(w * h, 4) AS area, round(w / h, 4) AS ratio FROM c"""),
    "polygon_measures": (polygon_measures, f"""WITH {V.BOXES}, p AS (SELECT frame_index, det_id, [l, r, r + category * 2, l + category * 2] AS xs, [t, t, b, b] AS ys FROM boxes),
e AS (SELECT frame_index, det_id, xs, ys, i, i % 4 + 1 AS j FROM p, (SELECT unnest([1, 2, 3, 4]) AS i)),
s AS (SELECT frame_index, det_id, sum(xs[i] * ys[j] - xs[j] * ys[i] ORDER BY i) AS d, sum((xs[i] + xs[j]) * (xs[i] * ys[j] - xs[j] * ys[i]) ORDER BY i) AS sx, sum((ys[i] + ys[j]) * (xs[i] * ys[j] - xs[j] * ys[i]) ORDER BY i) AS sy FROM e GROUP BY 1, 2)
SELECT frame_index, det_id, round(abs(d) / 2, 4) AS area, trunc(sx / (3 * d))::INTEGER AS x, trunc(sy / (3 * d))::INTEGER AS y FROM s"""),
    "tiles_to_frame": (tiles_to_frame, f"WITH {V.BOXES}, tiles AS (SELECT * FROM (VALUES {', '.join(str(t) for t in _tiles)}) AS t(tile_id, lx, uy)) SELECT frame_index, det_id, tile_id::INTEGER AS tile_id, round(l - 60 + lx, 4) AS l, round(t + 10 + uy, 4) AS t, round(r - 60 + lx, 4) AS r, round(b + 10 + uy, 4) AS b FROM boxes JOIN tiles ON tile_id = det_id % 6 WHERE l - 60 > 3 AND t + 10 > 3 AND r - 60 < 77 AND b + 10 < 67"),
    "tile_detections": (tile_detections, f"WITH {V.BOXES}, tiles AS (SELECT * FROM (VALUES {', '.join(str(t) for t in _tiles)}) AS t(tile_id, lx, uy)) SELECT frame_index, det_id, tile_id, cx - lx AS tile_x, cy - uy AS tile_y FROM boxes, tiles WHERE l - lx > 3 AND t - uy > 3 AND r - lx < 77 AND b - uy < 67"),
    "tile_plan": (tile_plan, """WITH v AS (SELECT s_suppkey AS video_id, (640 + s_suppkey % 7 * 211)::INTEGER AS w, (512 + s_suppkey % 5 * 97)::INTEGER AS h FROM supplier)
SELECT DISTINCT video_id, greatest(0, least(i * 540, w - 640))::INTEGER AS left_px, greatest(0, least(j * 412, h - 512))::INTEGER AS up_px FROM v, range(0, 20) AS a(i), range(0, 20) AS b(j)"""),
    "iou_pairs": (iou_pairs, f"WITH {V.BOXES}, {_pairs} SELECT frame_index, a, b, round(iou, 6) AS iou FROM pairs"),
    "unique_overlap": (unique_overlap, f"WITH {V.BOXES}, {_pairs}, s AS (SELECT *, count(*) OVER (PARTITION BY frame_index, a) AS na, count(*) OVER (PARTITION BY frame_index, b) AS nb FROM pairs WHERE iou >= 0.3) SELECT frame_index, a, b, round(iou, 6) AS iou FROM s WHERE na = 1 AND nb = 1"),
    "peak_cells": (peak_cells, f"WITH {V.HEAT} SELECT h.img_id, h.y, h.x, h.v FROM heat h WHERE h.v >= (SELECT max(g.v) FROM heat g WHERE g.img_id = h.img_id AND abs(g.y - h.y) <= 1 AND abs(g.x - h.x) <= 1)"),
    "top_k": (top_k, f"WITH {V.BOXES} SELECT frame_index, det_id, category, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY score DESC, det_id)::INTEGER AS rank FROM boxes) WHERE rank <= 3"),
    "confidence_filters": (confidence_filters, f"WITH {V.BOXES} SELECT category, count(*) FILTER (score > 30000) AS over, count(*) FILTER (score >= 30000) AS at_least, (array_agg(det_id ORDER BY score DESC, frame_index DESC, det_id DESC))[1] AS best FROM boxes GROUP BY category"),
    "pixel_statistics": (pixel_statistics, f"WITH {V.HEAT}, g AS (SELECT img_id, y, x, CASE WHEN v > 20 THEN v ELSE 0 END AS v FROM heat) SELECT img_id, round(avg((v = 0)::INTEGER), 4) AS black, min(x) FILTER (v > 0) AS left, max(x) FILTER (v > 0) AS right, min(y) FILTER (v > 0) AS top, max(y) FILTER (v > 0) AS bottom, max(v) AS brightest FROM g GROUP BY img_id"),
    "background": (background, f"WITH {V.HEAT} SELECT y, x, round(avg(v) FILTER (img_id < 3), 4) AS mean, max(v) AS top, count(*) AS n FROM heat GROUP BY y, x"),
    "gate_distance": (gate_distance, f"{Q}, d AS (SELECT veh_id, frame_index, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM points WINDOW w AS (PARTITION BY veh_id ORDER BY frame_index)), e AS (SELECT veh_id, frame_index, round(dx * dx / 900 + dy * dy / 400, 6) AS d2 FROM d WHERE dx IS NOT NULL) SELECT veh_id, frame_index, d2, d2 <= 5.9915 AS passes FROM e"),
}
