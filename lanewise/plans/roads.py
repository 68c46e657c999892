"""Queries on annotated roads, text forms and the height-led filter."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanewise.functions import geometry as G, kalman
from lanewise.operators import graphs, raster, roads as O, tracking as K
from lanewise.plans import views as V

LINES = [(n, [(5.0, 12.5 * n), (150.0, 12.5 * n + 4.0)]) for n in range(1, 7)]
DIRECTION = (0.8, 0.6)


def nearest_lane_line(spark, sf_dir):
    return O.between_lines(V.points(spark, sf_dir), LINES).select("veh_id", "frame_index", "lane")


def lane_strips(spark, sf_dir):
    """Areas between neighbouring lines of each region's nations."""
    n = F.col("n_nationkey")
    lines = V.table(spark, sf_dir, "nation").select(F.lit(0).alias("scene"), n.alias("number"), F.array(G.point(F.lit(0.0), n * 10), G.point(F.lit(100.0), n * 10 + n % 3)).alias("points")).filter("number % 6 <> 5")
    return O.strips(lines, "scene").select("number", F.round(G.polygon_area(F.col("ring")), 4).alias("area"))


def line_rebase(spark, sf_dir):
    p = V.points(spark, sf_dir).select("veh_id", "frame_index", "lane_id", F.col("x").alias("main"), F.col("y").alias("sub"))
    return O.rebased(p, ["lane_id"]).select("veh_id", "frame_index", F.round("position", 5).alias("position"))


def axis_ticks(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scene"), (F.col("s_suppkey") % 50).cast("double").alias("ox"), (F.col("s_suppkey") % 40).cast("double").alias("oy"))
    return O.axis_ticks(s, F.lit(10.0) + F.col("scene") % 8, DIRECTION, F.lit(640), F.lit(512)).select("scene", "tick", "tick_x", "tick_y")


def line_chain(spark, sf_dir):
    n = F.col("n_nationkey")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    parts = V.table(spark, sf_dir, "nation").select(n.alias("node"), F.lead("n_nationkey").over(w).alias("next"), (n * 1.5 + 1).alias("length"), (F.row_number().over(w) == 1).alias("is_base"))
    return graphs.distances(parts)


def overlap_region(spark, sf_dir):
    """Points inside the main region whose place before the map (x + 5, 2 y - 10) is inside the sub region."""
    main, sub = G.polygon([(10, 5), (140, 5), (140, 70), (10, 70)]), G.polygon([(0, 0), (90, 0), (90, 35), (0, 35)])
    p, to_main = V.points(spark, sf_dir), F.array(*[F.lit(v) for v in (1.0, 0.0, 5.0, 0.0, 2.0, -10.0)])
    n = raster.shared_region(p, main, sub, to_main).groupBy("veh_id").agg(F.count("*").alias("n"))
    return p.select("veh_id").distinct().join(n, "veh_id", "left").select("veh_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def detection_lines(spark, sf_dir):
    b = V.boxes(spark, sf_dir)
    return b.select("frame_index", "det_id", O.detection_line(F.concat(F.lit("c"), F.col("category").cast("string")), F.col("score") / 130000, [F.col(c) for c in "ltrb"]).alias("line"))


def match_lists(spark, sf_dir):
    """Ids of each frame's boxes by class, as lists in text."""
    return V.boxes(spark, sf_dir).groupBy("frame_index", "category").agg(F.array_join(F.sort_array(F.collect_list("det_id")), ";").alias("ids"))


def train_split(spark, sf_dir):
    return O.held_out(V.table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "class_no", "part")


def kalman_height(spark, sf_dir):
    p = V.points(spark, sf_dir).select("veh_id", "frame_index", "x", "y", (F.col("y") / 50 + 0.5).alias("aspect"), (F.col("x") / 4 + 20).alias("height"))
    out = K.filtered_by_height(p, "veh_id", "frame_index", ["x", "y", "aspect", "height"])
    return out.select("veh_id", "frame_index", *[F.round(f"f{i}", 3).alias(f"f{i}") for i in range(4)])


def turn_filter(spark, sf_dir):
    """Vehicles' places, yaw and sides by the filter of constant speed and turn rate."""
    yaw = F.col("frame_index") % 13 * 0.5 + F.col("lane_id")
    p = V.points(spark, sf_dir).select("veh_id", "frame_index", "x", "y", yaw.alias("yaw"), (F.col("x") / 4 + 20).alias("w"), (F.col("y") / 5 + 10).alias("h"))
    out = K.filtered_by_turn(p, "veh_id", "frame_index", ["x", "y", "yaw", "w", "h"])
    return out.select("veh_id", "frame_index", *[F.round(f"f{i}", 3).alias(n) for i, n in enumerate(("x", "y", "yaw", "vx", "vy", "turn", "w", "h"))])


def turn_sql() -> str:
    """The filter as a recursion: its matrices couple each value with its own speed alone."""
    d = lambda v: f"{v!r}::DOUBLE"
    dt, start, step, out = d(kalman.TURN_STEP), [], [], []
    for i, n in enumerate(("x", "y", "yaw")):
        q, q_speed = (kalman.TURN_STEP * (kalman.TURN_RATE if i == 2 else kalman.TURN_SPEED)) ** 2, (kalman.TURN_RATE if i == 2 else kalman.TURN_SPEED) ** 2
        start.append(f"{n}::DOUBLE AS f{i}, 0::DOUBLE AS s{i}, {d(kalman.TURN_START[i] ** 2)} AS p{i}, 0::DOUBLE AS c{i}, {d(kalman.TURN_START[i + 3] ** 2)} AS v{i}")
        gap = f"m.{n} - (k.f{i} + {dt} * k.s{i})"
        gap = f"pi() - (pi() - ({gap}) - 2 * pi() * floor((pi() - ({gap})) / (2 * pi())))" if i == 2 else gap
        step.append(f"k.f{i} + {dt} * k.s{i} AS g{i}, k.s{i} AS u{i}, k.p{i} + 2 * {dt} * k.c{i} + {dt} * {dt} * k.v{i} + {d(q)} AS pp{i}, k.c{i} + {dt} * k.v{i} AS cc{i}, k.v{i} + {d(q_speed)} AS vv{i}, {gap} AS z{i}")
        t = f"(pp{i} + {d(kalman.TURN_MEASURED[i] ** 2)})"
        out.append(f"g{i} + pp{i} / {t} * z{i} AS f{i}, u{i} + cc{i} / {t} * z{i} AS s{i}, pp{i} * (1 - pp{i} / {t}) AS p{i}, cc{i} * (1 - pp{i} / {t}) AS c{i}, vv{i} - cc{i} / {t} * cc{i} AS v{i}")
    for i, n in ((3, "w"), (4, "h")):
        start.append(f"{n}::DOUBLE AS f{i}, {d(kalman.TURN_START[i + 3] ** 2)} AS p{i}")
        step.append(f"k.f{i} AS g{i}, k.p{i} + {d(kalman.TURN_SIDE**2)} AS pp{i}, m.{n} - k.f{i} AS z{i}")
        t = f"(pp{i} + {d(kalman.TURN_MEASURED[i] ** 2)})"
        out.append(f"g{i} + pp{i} / {t} * z{i} AS f{i}, pp{i} * (1 - pp{i} / {t}) AS p{i}")
    shown = ", ".join(f"round({c}, 3) AS {n}" for c, n in (("f0", "x"), ("f1", "y"), ("f2", "yaw"), ("s0", "vx"), ("s1", "vy"), ("s2", "turn"), ("f3", "w"), ("f4", "h")))
    return f"""WITH RECURSIVE {V.POINTS},
m AS (SELECT veh_id, frame_index, x, y, frame_index % 13 * 0.5::DOUBLE + lane_id AS yaw, x / 4 + 20 AS w, y / 5 + 10 AS h, row_number() OVER (PARTITION BY veh_id ORDER BY frame_index) AS n FROM points),
k AS (SELECT veh_id, frame_index, n, {", ".join(start)} FROM m WHERE n = 1
  UNION ALL SELECT veh_id, frame_index, n, {", ".join(out)} FROM (SELECT m.veh_id, m.frame_index, m.n, {", ".join(step)} FROM k JOIN m ON m.veh_id = k.veh_id AND m.n = k.n + 1))
SELECT veh_id, frame_index, {shown} FROM k"""


def height_sql(gate: bool = False) -> str:
    """The filter as a recursion; with gate, the squared distances that it sees."""
    names, place, pace = ["x", "y", "aspect", "height"], "(1 / 20::DOUBLE)", "(1 / 160::DOUBLE)"
    power = lambda i, h, own, aspect: f"({aspect}::DOUBLE * {aspect}::DOUBLE)" if i == 2 else f"(({own} * {h}) * ({own} * {h}))"
    start = ", ".join(f"{n}::DOUBLE AS f{i}, 0::DOUBLE AS s{i}, {power(i, 'height', f'2 * {place}', '1e-2')} AS p{i}, 0::DOUBLE AS c{i}, {power(i, 'height', f'10 * {pace}', '1e-5')} AS v{i}" for i, n in enumerate(names))
    step = ", ".join(f"k.f{i} + k.s{i} AS g{i}, k.s{i} AS u{i}, k.p{i} + 2 * k.c{i} + k.v{i} + {power(i, 'k.f3', place, '1e-2')} AS pp{i}, k.c{i} + k.v{i} AS cc{i}, k.v{i} + {power(i, 'k.f3', pace, '1e-5')} AS vv{i}, m.{n} AS z{i}" for i, n in enumerate(names))
    t = lambda i: f"(pp{i} + {power(i, 'g3', place, '1e-1')})"
    out = ", ".join(f"g{i} + pp{i} / {t(i)} * (z{i} - g{i}) AS f{i}, u{i} + cc{i} / {t(i)} * (z{i} - g{i}) AS s{i}, pp{i} * (1 - pp{i} / {t(i)}) AS p{i}, cc{i} * (1 - pp{i} / {t(i)}) AS c{i}, vv{i} - cc{i} / {t(i)} * cc{i} AS v{i}" for i in range(4))
    far = ", " + " + ".join(f"(z{i} - g{i}) * (z{i} - g{i}) / {t(i)}" for i in range(4)) + " AS d2" if gate else ""
    return f"""WITH RECURSIVE {V.POINTS},
m AS (SELECT veh_id, frame_index, x, y, y / 50 + 0.5::DOUBLE AS aspect, x / 4 + 20 AS height, row_number() OVER (PARTITION BY veh_id ORDER BY frame_index) AS n FROM points),
k AS (SELECT veh_id, frame_index, n, {start}{", NULL::DOUBLE AS d2" if gate else ""} FROM m WHERE n = 1
  UNION ALL SELECT veh_id, frame_index, n, {out}{far} FROM (SELECT m.veh_id, m.frame_index, m.n, {step} FROM k JOIN m ON m.veh_id = k.veh_id AND m.n = k.n + 1))
SELECT veh_id, frame_index, {"round(d2, 3) AS d2, round(d2, 3) <= 9.4877 AS passes FROM k WHERE n > 1" if gate else "round(f0, 3) AS f0, round(f1, 3) AS f1, round(f2, 3) AS f2, round(f3, 3) AS f3 FROM k"}"""


_values = ", ".join(f"({n}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0] - a[0]}::DOUBLE, {b[1] - a[1]}::DOUBLE)" for n, (a, b) in LINES)
Q = "WITH " + V.POINTS

QUERIES = {
    "turn_filter": (turn_filter, turn_sql()),
    "nearest_lane_line": (nearest_lane_line, f"""{Q}, segs AS (SELECT * FROM (VALUES {_values}) AS s(n, x1, y1, dx, dy)),
t AS (SELECT *, greatest(0, least(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) AS t FROM points, segs),
d AS (SELECT *, row_number() OVER (PARTITION BY veh_id, frame_index ORDER BY sqrt((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2), n) AS k FROM t),
two AS (SELECT veh_id, frame_index, min(n) AS lo, max(n) AS hi FROM d WHERE k <= 2 GROUP BY 1, 2)
SELECT veh_id, frame_index, (CASE WHEN hi - lo = 1 THEN lo ELSE -1 END)::INTEGER AS lane FROM two"""),
    "lane_strips": (lane_strips, """WITH l AS (SELECT n_nationkey AS n, n_nationkey * 10::DOUBLE AS y1, n_nationkey * 10 + n_nationkey % 3::DOUBLE AS y2 FROM nation WHERE n_nationkey % 6 <> 5)
SELECT a.n AS number, round(100 * ((b.y1 - a.y1) + (b.y2 - a.y2)) / 2, 4) AS area FROM l a JOIN l b ON b.n = a.n + 1"""),
    "line_rebase": (line_rebase, f"{Q} SELECT veh_id, frame_index, round(y + max(x - y) OVER (PARTITION BY lane_id), 5) AS position FROM points"),
    "axis_ticks": (axis_ticks, f"""WITH t AS (SELECT s_suppkey AS scene, i::INTEGER AS tick, trunc((s_suppkey % 50)::DOUBLE + i * (10::DOUBLE + s_suppkey % 8) * {DIRECTION[0]}::DOUBLE)::INTEGER AS tick_x, trunc((s_suppkey % 40)::DOUBLE + i * (10::DOUBLE + s_suppkey % 8) * {DIRECTION[1]}::DOUBLE)::INTEGER AS tick_y
  FROM supplier, range(0, 201) AS r(i)) SELECT * FROM t WHERE tick_x BETWEEN 0 AND 639 AND tick_y BETWEEN 0 AND 511"""),
    "line_chain": (line_chain, "SELECT n_nationkey AS node, coalesce(sum(n_nationkey * 1.5::DOUBLE + 1) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS distance FROM nation"),
    "overlap_region": (overlap_region, f"{Q} SELECT veh_id, count(*) FILTER (x > 10 AND x < 140 AND y > 5 AND y < 70 AND x - 5 > 0 AND x - 5 < 90 AND (y + 10) / 2 > 0 AND (y + 10) / 2 < 35) AS n FROM points GROUP BY veh_id"),
    "detection_lines": (detection_lines, f"WITH {V.BOXES} SELECT frame_index, det_id, concat_ws(' ', 'c' || category, printf('%.6f', score / 130000), trunc(l)::INTEGER, trunc(t)::INTEGER, trunc(r)::INTEGER, trunc(b)::INTEGER) AS line FROM boxes"),
    "match_lists": (match_lists, f"WITH {V.BOXES} SELECT frame_index, category, string_agg(det_id::VARCHAR, ';' ORDER BY det_id) AS ids FROM boxes GROUP BY 1, 2"),
    "train_split": (train_split, "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::INTEGER AS class_no, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR)) <= ceil(count(*) OVER (PARTITION BY p_brand) * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS part FROM part"),
    "kalman_height": (kalman_height, height_sql()),
}
