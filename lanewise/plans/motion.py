"""Queries on sequences, trajectories, lines and graphs."""
from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanewise.functions import affine, geometry as G, heads
from lanewise.operators import graphs, relational as R, roads, tracking, trajectories as T
from lanewise.plans import tracks, views as V
from lanewise.sources import annotations

REGION = [(10.0, 5.0), (140.0, 5.0), (140.0, 70.0), (10.0, 70.0)]
OFFSETS = T.search_order(4)


def smooth_edge(spark, sf_dir):
    """Places smoothed over seven rows, ends repeated."""
    p = V.points(spark, sf_dir)
    return p.select("veh_id", "frame_index", *[F.round(R.centred_mean(p, c, ["veh_id"], "frame_index", 3), 4).alias(c) for c in ("x", "y")])


def longest_run(spark, sf_dir):
    return R.longest_run(V.points(spark, sf_dir), ["veh_id"])


def roi_select(spark, sf_dir):
    return R.in_region(V.points(spark, sf_dir), G.polygon(REGION), ["veh_id"]).select("veh_id", "frame_index")


def trajectory_meta(spark, sf_dir):
    t = T.build(V.points(spark, sf_dir), ["veh_id"])
    return t.select("veh_id", "first", "last", "n", "has_gaps", F.round(F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p.x), 3).alias("sum_x"))


def horizon(spark, sf_dir):
    """Vehicles first seen in a span of frames."""
    t = V.points(spark, sf_dir).groupBy("veh_id").agg(F.min("frame_index").alias("first"), F.max("frame_index").alias("last"))
    return t.filter("first >= 2 and first < 40")


def trail_tail(spark, sf_dir):
    t = R.trail(V.points(spark, sf_dir), ["veh_id"], "frame_index", 5)
    return t.select("veh_id", "frame_index", F.size("trail").alias("n"), F.round(F.aggregate("trail", F.lit(0.0), lambda acc, p: acc + p.x) / F.size("trail"), 9).alias("mean_x"))


def reindex_frames(spark, sf_dir):
    f = T.reindexed(F.col("frame_index"), F.lit(125), F.lit(40), F.lit(25), F.lit(80), F.lit(3), F.lit(0))
    return V.points(spark, sf_dir).select("veh_id", "frame_index", f.alias("main_frame"))


def _sides(spark, sf_dir):
    p = V.points(spark, sf_dir)
    return p.filter("veh_id % 2 = 0").withColumnRenamed("veh_id", "a"), p.filter("veh_id % 2 = 1").withColumnRenamed("veh_id", "b")


def similarity(spark, sf_dir):
    """Every even vehicle with every odd one that it shares frames with."""
    return T.similarity(*_sides(spark, sf_dir)).withColumn("dist", F.round("dist", 4))


def lane_mode(spark, sf_dir):
    return T.lane_smoothed(V.points(spark, sf_dir), ["veh_id"]).select("veh_id", "frame_index", "lane_mode")


def _clusters(spark, sf_dir):
    """Vehicles in threes."""
    return V.points(spark, sf_dir).select("veh_id").distinct().filter("veh_id % 5 < 3").withColumn("cluster", (F.col("veh_id") - F.col("veh_id") % 5).cast("long"))


def fuse_cluster(spark, sf_dir):
    f = T.fused(V.points(spark, sf_dir), _clusters(spark, sf_dir))
    return f.select("cluster", "frame_index", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "lane_id", "whole")


def fused_set(spark, sf_dir):
    p, c = V.points(spark, sf_dir), _clusters(spark, sf_dir)
    s = T.with_unmatched(T.fused(p, c), p, c)
    return s.groupBy("id", "is_fused").agg(F.count("*").alias("n"), F.min("frame_index").alias("first"))


def cross_fade(spark, sf_dir):
    p = V.points(spark, sf_dir).withColumn("k", F.floor(F.col("veh_id") / 2))
    out = T.cross_faded(p.filter("veh_id % 2 = 0"), p.filter("veh_id % 2 = 1"), ["k"])
    return out.select("k", "frame_index", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "shared")


def joined_pairs(spark, sf_dir):
    """Vehicles in pairs, each as one trajectory where they overlap in part."""
    p = V.points(spark, sf_dir).withColumns({"k": F.floor(F.col("veh_id") / 2), "line_pos": F.col("x") * 0.5 + F.col("y"), "line_offset": F.col("y") - F.col("x")})
    out = T.joined(p.filter("veh_id % 2 = 0"), p.filter("veh_id % 2 = 1"), ["k"])
    return out.select("k", "frame_index", *[F.round(F.col(c) + 3.3e-9, 6).alias(c) for c in ("x", "y", "line_pos", "line_offset")], "lane_id")


def tracked_trajectories(spark, sf_dir):
    """Tracks of videos as trajectories: a row a track with its ends, length, start and step in time."""
    b = tracks.video_boxes(spark, sf_dir, turned=False)
    t = tracking.track(b, max_age=5).withColumns({"x": (F.col("l") + F.col("r")) / 2, "y": (F.col("t") + F.col("b")) / 2, "lane_id": F.lit(-1), "ms": F.col("frame_index") * 40.0})
    return T.build(t, ["video_id", "track_id"], "ms").select("video_id", "track_id", "first", "last", "n", "has_gaps", "start_ms", "delta_ms")


def project_line(spark, sf_dir):
    out = T.line_places(V.points(spark, sf_dir), V.LINE, (20.0, 30.0), 0.5, 100.0)
    return out.select("veh_id", "frame_index", F.round("line_pos", 3).alias("line_pos"), F.round("line_offset", 3).alias("line_offset"))


def entry_exit_filter(spark, sf_dir):
    p = T.line_places(V.points(spark, sf_dir), V.LINE, V.LINE[0]).select("veh_id", "frame_index", F.round("line_pos", 6).alias("pos"))
    matched = p.select("veh_id").distinct().filter("veh_id % 7 = 0")
    return T.kept_by_ends(p, matched, 5.0, 2)


def asof_align(spark, sf_dir):
    """Each purchase with the next click of its user, not earlier."""
    e = V.table(spark, sf_dir, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.min("event_id").alias("click_id"))
    return R.as_of(left, right, ["user_id"], "ts", "click_id").select("event_id", "click_id")


def clock_clamp(spark, sf_dir):
    """Frames with their clock; later frames keep its last entry."""
    p = V.points(spark, sf_dir).select(F.col("veh_id").alias("video_id"), "frame_index")
    clock = p.filter("frame_index < 300").withColumn("unix_ms", F.col("frame_index") * 3_600_000)
    return R.clamped_clock(p, clock).select("video_id", "frame_index", "unix_ms")


def fps_common(spark, sf_dir):
    """Frame rates of two videos, their greatest common divisor and the steps that bring both to it."""
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 6 * 5 + 10).cast("int").alias("p"), (F.col("s_suppkey") % 4 * 10 + 20).cast("int").alias("q"))
    g, step_p, step_q = R.common_rate(F.col("p"), F.col("q"))
    return s.select("id", g.alias("g"), step_p.alias("step_p"), step_q.alias("step_q"))


def graph_to_main(spark, sf_dir):
    """Each video's way to the main one: depth, offset and the map composed along it."""
    n = F.col("src")
    edge = F.array(1 + n / 100, n / 200, n * 1.0, -n / 200, 1 - n / 100, n * -2.0)
    out = graphs.paths_to_root(V.graph(spark, sf_dir).withColumns({"shift": n * 0.5, "map": edge}), 0)
    return out.select("node", "depth", "shift", *[F.round(v, 6).alias(f"m{i}") for i, v in enumerate(affine.parts(F.col("map")))])


def match_clusters(spark, sf_dir):
    """Chains of orders, each paired with the next of its group: the first one names the chain."""
    chain = Window.partitionBy(F.col("o_custkey") % 500).orderBy("o_orderkey")
    pairs = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(chain).alias("b")).filter("b is not null")
    return graphs.clusters(pairs)


def unmatched(spark, sf_dir):
    p = V.points(spark, sf_dir)
    return p.join(_clusters(spark, sf_dir), "veh_id", "left_anti").groupBy("veh_id").agg(F.count("*").alias("n"))


def gallery_last_k(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select(F.col("label").alias("target"), F.col("vec_id").alias("seq"))
    return R.last_samples(e, "target", "seq", 10)


def subtitle_times(spark, sf_dir):
    """Clock strings `yyyy-MM-dd HH:mm:ss,mmm,uuu` to milliseconds since 1970, in UTC, whatever the session's zone."""
    e = V.table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(",622")).alias("s"))
    return e.select("event_id", annotations.clock_ms(F.col("s")).alias("unix_ms"))


def skip_intervals(spark, sf_dir):
    """Frames inside any of a list of closed intervals."""
    return V.points(spark, sf_dir).groupBy("frame_index").agg(F.count("*").alias("n")).withColumn("skip", R.in_spans(F.col("frame_index"), [(3, 9), (50, 50), (100, 180)]))


def affine_parts(spark, sf_dir):
    """Shift and turn of frame transforms, and the matrix without its scale."""
    p = V.points(spark, sf_dir)
    a, c = F.col("x") / 50 + 1, F.col("y") / 80
    m = p.withColumn("m", F.array(a, -c, F.col("x"), c, a, F.col("y")))
    turned, free = affine.parts(affine.normal(F.col("m"))), affine.parts(affine.normal(F.col("m"), keep_scale=False, keep_shift=False))
    names = {"turn": F.atan2(free[3], free[0]), "a": free[0], "c": turned[3], "scale": F.hypot(turned[0], turned[3]), "tx": turned[2], "free_tx": free[2]}
    return m.select("veh_id", "frame_index", *[F.round(v, 5).alias(n) for n, v in names.items()])


def head_decode(spark, sf_dir):
    """Boxes from grid outputs: centre is cell and offset times stride, sides are exponentials, score a product of logistic values."""
    h = V.heat(spark, sf_dir)
    v = F.col("v").cast("double")
    names = heads.grid_head(F.col("x"), F.col("y"), F.lit(32), [v / 100, v / 200, v / 25, v / 50, v / 10 - 2, 3 - v / 20])
    return h.select("cell", *[F.round(c, 4).alias(n) for n, c in names.items()]).filter("score >= 0.2")


def letterbox(spark, sf_dir):
    """Scale and padding that fit an image into 640 x 512."""
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (300 + F.col("s_suppkey") % 13 * 97).alias("w"), (200 + F.col("s_suppkey") % 11 * 83).alias("h"))
    fit = heads.letterbox(F.col("w"), F.col("h"), 640, 512)
    return s.select("id", F.round(fit["scale"], 6).alias("scale"), fit["pad_x"].alias("pad_x"), fit["pad_y"].alias("pad_y"))


def labels(spark, sf_dir):
    b = V.boxes(spark, sf_dir)
    text = heads.label({"id": ("%d", F.col("det_id")), "cat": ("%d", F.col("category")), "w": ("%d", F.col("w").cast("int"))})
    return b.select("frame_index", "det_id", text.alias("text"))


def learning_rates(spark, sf_dir):
    """A cosine schedule over 40 epochs, at the epoch of each order."""
    epoch = F.col("o_orderkey") % 40
    return V.table(spark, sf_dir, "orders").select("o_orderkey", epoch.alias("epoch"), F.round(R.cosine_rate(epoch, 40, 0.1), 6).alias("rate"))


def video_parts(spark, sf_dir):
    """Parts of a video: frames before each, changes of rate, and the total."""
    v = V.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("video_id"), F.col("s_suppkey").alias("part_no"), (F.col("s_suppkey") % 50 + 10).alias("frames"), (F.col("s_suppkey") % 3 * 5 + 20).alias("fps"))
    return annotations.part_spans(v).select("video_id", "part_no", "before", "changed", "total")


def line_ticks(spark, sf_dir):
    """Points every 15 units along the driving line of each supplier's road."""
    k = F.col("s_suppkey")
    points = F.array(*[G.point(F.lit(x) + k % 7, F.lit(y) + k % 5 * (1 + i)) for i, (x, y) in enumerate(V.LINE)])
    t = roads.line_ticks(V.table(spark, sf_dir, "supplier").select(k.alias("video_id"), points.alias("points")), ["video_id"], 15.0)
    return t.select("video_id", "d", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def offset_search(spark, sf_dir):
    """Mean difference of paired trajectories for each shift in frames, in the order of search, and the best so far."""
    a, b = _sides(spark, sf_dir)
    moved = T.shifted(b.withColumn("a", F.col("b") - 1), OFFSETS)
    gap = F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y"))
    per = a.alias("l").join(moved.alias("r"), ["a", "frame_index"]).groupBy("offset").agg(F.count("*").alias("n"), F.round(F.avg(gap), 4).alias("mean"))
    place = F.array_position(F.array(*[F.lit(o) for o in OFFSETS]), F.col("offset"))
    so_far = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("best", F.min("mean").over(so_far))


def _segs_sql() -> str:
    rows, run = [], 0.0
    for i, (a, b) in enumerate(zip(V.LINE, V.LINE[1:], strict=False)):
        rows.append(f"({i}, {run!r}::DOUBLE, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0] - a[0]}::DOUBLE, {b[1] - a[1]}::DOUBLE)")
        run += math.dist(a, b)
    return f'segs AS (SELECT * FROM (VALUES {", ".join(rows)}) AS s(i, run, x1, y1, dx, dy))'


def _line_sql() -> str:
    return f"""{_segs_sql()},
t AS (SELECT veh_id, frame_index, x, y, i, run, x1, y1, dx, dy, greatest(0, least(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) AS t FROM points, segs),
d AS (SELECT *, sqrt((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2) AS dist, run + t * sqrt(dx * dx + dy * dy) AS pos, sign(dx * (y - y1) - dy * (x - x1)) AS side FROM t),
near AS (SELECT veh_id, frame_index, pos, dist, side FROM (SELECT *, row_number() OVER (PARTITION BY veh_id, frame_index ORDER BY dist, i) AS n FROM d) WHERE n = 1)"""


_base = math.dist(V.LINE[0], V.LINE[1])
Q = "WITH " + V.POINTS
_mean = lambda c: f"(sum({c}) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + greatest(0, 4 - row_number() OVER w) * first_value({c}) OVER f + greatest(0, row_number() OVER w + 3 - count(*) OVER f) * last_value({c}) OVER f) / 7"
_run = """r0 AS (SELECT veh_id, frame_index, CASE WHEN abs(frame_index - lag(frame_index) OVER (PARTITION BY veh_id ORDER BY frame_index)) > 1 THEN 1 ELSE 0 END AS s FROM src),
r1 AS (SELECT veh_id, frame_index, sum(s) OVER (PARTITION BY veh_id ORDER BY frame_index) AS run FROM r0),
r2 AS (SELECT veh_id, run, min(frame_index) AS first, max(frame_index) AS last, count(*) AS n FROM r1 GROUP BY 1, 2),
best AS (SELECT veh_id, first, last, n FROM (SELECT *, row_number() OVER (PARTITION BY veh_id ORDER BY n DESC, first) AS k FROM r2) WHERE k = 1)"""
_sides_sql = "l AS (SELECT veh_id AS a, frame_index, x, y, lane_id FROM points WHERE veh_id % 2 = 0), r AS (SELECT veh_id AS b, frame_index, x, y, lane_id FROM points WHERE veh_id % 2 = 1)"
_clus = "c AS (SELECT DISTINCT veh_id, veh_id - veh_id % 5 AS cluster FROM points WHERE veh_id % 5 < 3)"
_fused = "fused AS (SELECT cluster, frame_index, avg(x) AS x, avg(y) AS y, min(lane_id) AS lane_id FROM points JOIN c USING (veh_id) GROUP BY 1, 2)"

QUERIES = {
    "smooth_edge": (smooth_edge, f"{Q} SELECT veh_id, frame_index, round({_mean('x')}, 4) AS x, round({_mean('y')}, 4) AS y FROM points WINDOW w AS (PARTITION BY veh_id ORDER BY frame_index), f AS (PARTITION BY veh_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "longest_run": (longest_run, f"{Q}, src AS (SELECT * FROM points), {_run} SELECT * FROM best"),
    "roi_select": (roi_select, f"{Q}, inside AS (SELECT *, count(*) OVER (PARTITION BY veh_id) AS k FROM points WHERE trunc(x) > 10 AND trunc(x) < 140 AND trunc(y) > 5 AND trunc(y) < 70), src AS (SELECT * FROM inside WHERE k > 5), {_run} SELECT veh_id, frame_index FROM src JOIN best USING (veh_id) WHERE frame_index BETWEEN first AND last"),
    "trajectory_meta": (trajectory_meta, f"{Q} SELECT veh_id, min(frame_index) AS first, max(frame_index) AS last, count(*) AS n, max(frame_index) - min(frame_index) + 1 > count(*) AS has_gaps, round(sum(x), 3) AS sum_x FROM points GROUP BY veh_id"),
    "horizon": (horizon, f"{Q} SELECT veh_id, min(frame_index) AS first, max(frame_index) AS last FROM points GROUP BY veh_id HAVING min(frame_index) >= 2 AND min(frame_index) < 40"),
    "trail_tail": (trail_tail, f"{Q} SELECT veh_id, frame_index, (count(*) OVER w)::INTEGER AS n, round(avg(x) OVER w, 9) AS mean_x FROM points WINDOW w AS (PARTITION BY veh_id ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"),
    "reindex_frames": (reindex_frames, f"{Q} SELECT veh_id, frame_index, round_even((frame_index * 40 + 125 - 25) / 80 + 3, 0)::BIGINT AS main_frame FROM points"),
    "similarity": (similarity, f"""{Q}, {_sides_sql}, p AS (SELECT a, b, max(frame_index) - min(frame_index) AS span, (sqrt(sum((l.x - r.x) ** 2)) + sqrt(sum((l.y - r.y) ** 2))) / 2 AS gap, avg(abs(l.lane_id - r.lane_id)) AS lg, max(l.lane_id) AS al, max(r.lane_id) AS bl,
  (max_by(l.x, frame_index) - min_by(l.x, frame_index)) * (max_by(r.x, frame_index) - min_by(r.x, frame_index)) + (max_by(l.y, frame_index) - min_by(l.y, frame_index)) * (max_by(r.y, frame_index) - min_by(r.y, frame_index)) AS dot
  FROM l JOIN r USING (frame_index) GROUP BY a, b)
SELECT a, b, round(CASE WHEN span < 5 OR dot < 0 THEN 1e5 ELSE gap + CASE WHEN al BETWEEN 1 AND 49 OR bl BETWEEN 1 AND 49 THEN 100 * lg ELSE 0 END END, 4) AS dist FROM p"""),
    "lane_mode": (lane_mode, f"{Q}, n AS (SELECT veh_id, lane_id, count(*) AS n FROM points GROUP BY 1, 2), m AS (SELECT veh_id, lane_id AS lane_mode FROM (SELECT *, row_number() OVER (PARTITION BY veh_id ORDER BY n DESC, lane_id) AS k FROM n) WHERE k = 1) SELECT veh_id, frame_index, lane_mode FROM points JOIN m USING (veh_id)"),
    "fuse_cluster": (fuse_cluster, f"{Q}, {_clus}, {_fused} SELECT cluster, frame_index, round(x, 4) AS x, round(y, 4) AS y, lane_id, max(frame_index) OVER w - min(frame_index) OVER w + 1 = count(*) OVER w AS whole FROM fused WINDOW w AS (PARTITION BY cluster)"),
    "fused_set": (fused_set, f"{Q}, {_clus}, {_fused} SELECT cluster AS id, true AS is_fused, count(*) AS n, min(frame_index) AS first FROM fused GROUP BY cluster UNION ALL SELECT veh_id, false, count(*), min(frame_index) FROM points WHERE veh_id NOT IN (SELECT veh_id FROM c) GROUP BY veh_id"),
    "tracked_trajectories": (tracked_trajectories, None),
    "joined_pairs": (joined_pairs, f"""{Q}, p AS (SELECT *, veh_id // 2 AS k, x * 0.5 + y AS line_pos, y - x AS line_offset FROM points),
e AS (SELECT k, min(frame_index) FILTER (veh_id % 2 = 0) AS m0, max(frame_index) FILTER (veh_id % 2 = 0) AS m1, min(frame_index) FILTER (veh_id % 2 = 1) AS s0, max(frame_index) FILTER (veh_id % 2 = 1) AS s1 FROM p GROUP BY k),
w AS (SELECT k, CASE WHEN m0 < s0 THEN 0 ELSE 1 END AS early FROM e WHERE (m0 < s0 AND s0 < m1 AND m1 < s1) OR (s0 < m0 AND m0 < s1 AND s1 < m1)),
f AS (SELECT p.*, veh_id % 2 = early AS is_first, count(*) OVER (PARTITION BY k, frame_index) = 2 AS shared FROM p JOIN w USING (k)),
r AS (SELECT *, dense_rank() OVER (PARTITION BY k, shared ORDER BY frame_index) - 1 AS i, count(DISTINCT CASE WHEN shared THEN frame_index END) OVER (PARTITION BY k) AS n FROM f),
g AS (SELECT *, CASE WHEN NOT shared THEN 1 WHEN is_first THEN 1 - i / n ELSE i / n END AS share, NOT shared OR is_first <> (i >= n - (n - 1) // 2) AS gives FROM r)
SELECT k, frame_index, round(sum(x * share) + 3.3e-9, 6) AS x, round(sum(y * share) + 3.3e-9, 6) AS y, round(sum(line_pos * share) + 3.3e-9, 6) AS line_pos, round(sum(line_offset * share) + 3.3e-9, 6) AS line_offset, max(lane_id) FILTER (gives) AS lane_id FROM g GROUP BY k, frame_index"""),
    "cross_fade": (cross_fade, f"""{Q}, p AS (SELECT *, (veh_id // 2)::BIGINT AS k FROM points), j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.frame_index, b.frame_index) AS frame_index, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bey, a.x IS NOT NULL AND b.x IS NOT NULL AS shared
  FROM (SELECT * FROM p WHERE veh_id % 2 = 0) a FULL JOIN (SELECT * FROM p WHERE veh_id % 2 = 1) b ON a.k = b.k AND a.frame_index = b.frame_index),
s AS (SELECT *, (row_number() OVER (PARTITION BY k, shared ORDER BY frame_index) - 1) / count(*) OVER (PARTITION BY k, shared) AS w FROM j)
SELECT k, frame_index, round(CASE WHEN shared THEN ax * (1 - w) + bx * w ELSE coalesce(ax, bx) END, 9) AS x, round(CASE WHEN shared THEN ay * (1 - w) + bey * w ELSE coalesce(ay, bey) END, 9) AS y, shared FROM s"""),
    "project_line": (project_line, f"{Q}, {_line_sql()} SELECT veh_id, frame_index, round((pos - {_base!r}::DOUBLE) * 0.5 + 100, 3) AS line_pos, round(dist * side * 0.5, 3) AS line_offset FROM near"),
    "entry_exit_filter": (entry_exit_filter, f"""{Q}, {_line_sql()}, n AS (SELECT veh_id, frame_index, round(pos, 6) AS pos FROM near), s AS (SELECT veh_id, min(frame_index) AS first, min_by(pos, frame_index) AS pos FROM n GROUP BY veh_id)
SELECT veh_id FROM s WHERE veh_id % 7 = 0 OR first < 2 OR pos < (SELECT min(pos) FROM n) + 5 OR pos > (SELECT max(pos) FROM n) - 5"""),
    "asof_align": (asof_align, "WITH r AS (SELECT user_id, ts, min(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1, 2), l AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase') SELECT event_id, click_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.ts"),
    "clock_clamp": (clock_clamp, f"{Q}, c AS (SELECT veh_id, max(frame_index) AS last FROM points WHERE frame_index < 300 GROUP BY 1) SELECT veh_id AS video_id, frame_index, CASE WHEN last IS NOT NULL THEN least(frame_index, last) * 3600000 END AS unix_ms FROM points LEFT JOIN c USING (veh_id)"),
    "fps_common": (fps_common, "WITH s AS (SELECT s_suppkey AS id, (s_suppkey % 6 * 5 + 10)::INTEGER AS p, (s_suppkey % 4 * 10 + 20)::INTEGER AS q FROM supplier) SELECT id, gcd(p, q)::INTEGER AS g, (p // gcd(p, q))::INTEGER AS step_p, (q // gcd(p, q))::INTEGER AS step_q FROM s"),
    "graph_to_main": (graph_to_main, f"""WITH RECURSIVE {V.GRAPH},
e AS (SELECT src, dst, 1 + src / 100 AS a, src / 200 AS b, src::DOUBLE AS tx, -src / 200 AS c, 1 - src / 100 AS d, src * -2::DOUBLE AS ty FROM graph),
walk AS (SELECT 0 AS node, 0 AS depth, 0::DOUBLE AS shift, 1::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS tx, 0::DOUBLE AS c, 1::DOUBLE AS d, 0::DOUBLE AS ty
  UNION ALL SELECT e.src, depth + 1, shift + e.src * 0.5::DOUBLE, w.a * e.a + w.b * e.c, w.a * e.b + w.b * e.d, w.a * e.tx + w.b * e.ty + w.tx, w.c * e.a + w.d * e.c, w.c * e.b + w.d * e.d, w.c * e.tx + w.d * e.ty + w.ty
  FROM walk w JOIN e ON e.dst = w.node)
SELECT node, depth, shift, round(a, 6) AS m0, round(b, 6) AS m1, round(tx, 6) AS m2, round(c, 6) AS m3, round(d, 6) AS m4, round(ty, 6) AS m5 FROM walk"""),
    "match_clusters": (match_clusters, "SELECT node, cluster FROM (SELECT o_orderkey AS node, min(o_orderkey) OVER w AS cluster, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey % 500)) WHERE n > 1"),
    "unmatched": (unmatched, f"{Q} SELECT veh_id, count(*) AS n FROM points WHERE veh_id % 5 >= 3 GROUP BY veh_id"),
    "gallery_last_k": (gallery_last_k, "SELECT target, seq FROM (SELECT label AS target, vec_id AS seq, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS n FROM embeddings) WHERE n <= 10"),
    "subtitle_times": (subtitle_times, "SELECT event_id, epoch_us(ts) // 1000 AS unix_ms FROM events"),
    "skip_intervals": (skip_intervals, f"{Q} SELECT frame_index, count(*) AS n, frame_index BETWEEN 3 AND 9 OR frame_index = 50 OR frame_index BETWEEN 100 AND 180 AS skip FROM points GROUP BY frame_index"),
    "affine_parts": (affine_parts, f"{Q}, m AS (SELECT *, x / 50 + 1 AS a, y / 80 AS c FROM points) SELECT veh_id, frame_index, round(atan2(c, a), 5) AS turn, round(cos(atan2(c, a)), 5) AS a, round(c, 5) AS c, round(sqrt(a * a + c * c), 5) AS scale, round(x, 5) AS tx, 0::DOUBLE AS free_tx FROM m"),
    "head_decode": (head_decode, f"WITH {V.HEAT}, d AS (SELECT cell, round((x + v / 100) * 32, 4) AS cx, round((y + v / 200) * 32, 4) AS cy, round(exp(v / 25) * 32, 4) AS w, round(exp(v / 50) * 32, 4) AS h, round(1 / (1 + exp(-(v / 10 - 2))) * (1 / (1 + exp(-(3 - v / 20)))), 4) AS score FROM (SELECT cell, x, y, v::DOUBLE AS v FROM heat)) SELECT * FROM d WHERE score >= 0.2"),
    "letterbox": (letterbox, "WITH s AS (SELECT s_suppkey AS id, 300 + s_suppkey % 13 * 97 AS w, 200 + s_suppkey % 11 * 83 AS h FROM supplier), k AS (SELECT *, least(640::DOUBLE / w, 512::DOUBLE / h) AS k FROM s) SELECT id, round(k, 6) AS scale, ((640 - trunc(w * k)::INTEGER) // 2)::INTEGER AS pad_x, ((512 - trunc(h * k)::INTEGER) // 2)::INTEGER AS pad_y FROM k"),
    "labels": (labels, f"WITH {V.BOXES} SELECT frame_index, det_id, 'id:' || det_id || ' cat:' || category || ' w:' || trunc(w)::INTEGER AS text FROM boxes"),
    "learning_rates": (learning_rates, "SELECT o_orderkey, o_orderkey % 40 AS epoch, round(((1 + cos((o_orderkey % 40) * pi() / 40)) / 2) * 0.9::DOUBLE + 0.1::DOUBLE, 6) AS rate FROM orders"),
    "video_parts": (video_parts, "WITH v AS (SELECT s_nationkey AS video_id, s_suppkey AS part_no, s_suppkey % 50 + 10 AS frames, s_suppkey % 3 * 5 + 20 AS fps FROM supplier) SELECT video_id, part_no, coalesce(sum(frames) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, coalesce(lag(fps) OVER w <> fps, false) AS changed, (sum(frames) OVER (PARTITION BY video_id))::BIGINT AS total FROM v WINDOW w AS (PARTITION BY video_id ORDER BY part_no)"),
    "line_ticks": (line_ticks, f"""WITH c AS (SELECT s_suppkey AS video_id, i, x + s_suppkey % 7 AS x, y + s_suppkey % 5 * (1 + i) AS y FROM supplier, (VALUES {", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(V.LINE))}) AS p(i, x, y)),
e AS (SELECT video_id, i, x, y, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM c WINDOW w AS (PARTITION BY video_id ORDER BY i)),
n AS (SELECT *, sqrt(dx * dx + dy * dy) AS n FROM e WHERE dx IS NOT NULL),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM n),
k AS (SELECT *, k * 15::DOUBLE AS d FROM r, range(0, 30) AS t(k) WHERE k * 15 >= run AND k * 15 < run + n)
SELECT video_id, d, round(x + (d - run) / n * dx, 4) AS x, round(y + (d - run) / n * dy, 4) AS y FROM k"""),
    "offset_search": (offset_search, f"""{Q}, o AS (SELECT * FROM (VALUES {", ".join(f"({i}, {o})" for i, o in enumerate(OFFSETS))}) AS o(k, off)), l AS (SELECT * FROM points WHERE veh_id % 2 = 0), r AS (SELECT veh_id - 1 AS a, frame_index, x, y FROM points WHERE veh_id % 2 = 1),
m AS (SELECT k, off, count(*) AS n, round(avg(sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2)), 4) AS mean FROM l JOIN r ON l.veh_id = r.a JOIN o ON l.frame_index = r.frame_index + off GROUP BY 1, 2)
SELECT off::INTEGER AS "offset", n, mean, min(mean) OVER (ORDER BY k) AS best FROM m"""),
}
