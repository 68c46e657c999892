"""Operators on small cases with known answers, and against plain Python."""
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.functions import geometry as G
from lanewise.functions.assignment import assign, box_iou, figure_iou, suppress
from lanewise.functions.kalman import NOISE, BoxFilter
from lanewise.operators import graphs, matching as M, relational as R, tracking as K, trajectories as T


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_longest_run(spark):
    frames = [(1, f) for f in (4, 5, 8, 9, 10, 11, 20, 21, 22, 23, 24, 40)] + [(2, 4), (2, 4), (2, 5)]
    got = {r.v: (r.first, r["last"], r.n) for r in R.longest_run(spark.createDataFrame(frames, "v int, frame_index long"), ["v"]).collect()}
    assert got == {1: (20, 24, 5), 2: (4, 5, 3)}


def test_foot_point(spark):
    x, y = one(spark, *G.foot_point(*[F.lit(float(v)) for v in (30, 45, 12, 7, 90, 33)]))
    assert (round(x, 4), round(y, 4)) == (39.6, 16.2)


@pytest.mark.parametrize(("p", "expected"), [((2, 2), True), ((0, 0), False), ((4, 2), False), ((5, 2), False), ((2, 4), False)])
def test_boundary_is_outside(spark, p, expected):
    square = G.polygon([(0, 0), (4, 0), (4, 4), (0, 4)])
    assert one(spark, G.inside(F.lit(float(p[0])), F.lit(float(p[1])), square))[0] is expected


def test_affine_of_three_points(spark):
    src, dst = [(0, 0), (1, 0), (0, 1)], [(5, 7), (7, 8), (4, 10)]
    lit = lambda ps: [(F.lit(float(x)), F.lit(float(y))) for x, y in ps]
    m = G.solve_affine(lit(src), lit(dst))
    assert one(spark, *G.affine(F.lit(3.0), F.lit(2.0), m)) == (5 + 3 * 2 - 2, 7 + 3 + 2 * 3)


def test_area_and_centre(spark):
    ring = G.polygon([(0, 0), (10, 0), (10, 4), (0, 4)])
    assert one(spark, G.polygon_area(ring), *G.polygon_centre(ring)) == (20.0 * 2, 5, 2)


def test_tile_starts():
    assert R.tile_starts(1000, 640, 100) == [0, 360] and R.tile_starts(512, 512, 100) == [0]


def test_half_even_frames(spark):
    f = lambda i: T.reindexed(F.lit(i), F.lit(0), F.lit(1), F.lit(0), F.lit(2), F.lit(0), F.lit(0))
    assert one(spark, f(1), f(3), f(5)) == (0, 2, 2)


def test_similarity(spark):
    rows = lambda k, dx, dy: spark.createDataFrame([(1, f, f + dx, f * 1.0 + dy, 60) for f in range(6)], f"{k} int, frame_index int, x double, y double, lane_id int")
    got = T.similarity(rows("a", 0.0, 0.0), rows("b", 3.0, 4.0)).first().dist
    assert round(got, 4) == round((54**0.5 + 96**0.5) / 2, 4)
    short = T.similarity(rows("a", 0.0, 0.0).filter("frame_index < 5"), rows("b", 3.0, 4.0)).first().dist
    assert short == T.NO_MATCH


def test_similarity_in_blocks(spark, monkeypatch):
    """All vehicles in blocks of many tasks give what the join on frames gives, with unknown places and lanes, lanes off the road and long gaps."""
    for name, value in (("PART", 16), ("VEHICLES", 60), ("FEW", 500)):
        monkeypatch.setattr(T, name, value)
    known = lambda c, every: F.when(F.pmod(F.xxhash64("v", "frame_index", F.lit(every)), F.lit(every)) > 0, c)
    points = spark.range(300 * 40).select((F.col("id") % 300).alias("v"), (F.floor(F.col("id") / 300) * F.when(F.col("id") % 7 == 0, 50).otherwise(1)).alias("frame_index"))
    points = points.filter(F.pmod(F.xxhash64("v", "frame_index"), F.lit(3)) > 0).withColumns(
        {
            "x": known((F.col("frame_index") * 0.25 + F.pmod(F.hash("v", "frame_index"), F.lit(4000)) / 100), 19),
            "y": F.when(F.col("v") != 5, known(F.col("v") * 0.5 - F.col("frame_index") * (F.col("v") % 3 - 1), 23)),
            "lane_id": F.when(F.col("v") % 11 > 0, known(F.when(F.col("v") % 13 == 0, 60).otherwise(F.col("frame_index") % 4 - F.col("v") % 2), 3)).cast("int"),
        }
    )
    a, b = (points.filter(F.col("v") % 2 == k).withColumnRenamed("v", n) for k, n in ((0, "a"), (1, "b")))
    got = {(r.a, r.b): r.dist for r in T.similarity(a, b).collect()}
    rows = T.similarity(a.withColumn("k", F.lit(1)), b.withColumn("k", F.lit(1)), by=["k"]).collect()
    want = {(r.a, r.b): r.dist for r in rows}
    assert len(rows) == len(want) and got.keys() == want.keys() and None in want.values() and len({v == T.NO_MATCH for v in want.values()}) == 2
    for k, v in want.items():
        assert got[k] == v if v is None else abs(got[k] - v) < 1e-6, (k, v, got[k])
    assert T.similarity(a.filter("a < 0"), b).count() == 0


def test_smoothing_keeps_constants(spark):
    df = spark.createDataFrame([(1, i, 7.0) for i in range(4)], "v int, f int, x double")
    assert {r[0] for r in df.select(R.centred_mean(df, "x", ["v"], "f", 3)).collect()} == {7.0}


def test_clusters(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4), (2, 3), (10, 11)], "a long, b long")
    got = {r.node: r.cluster for r in graphs.clusters(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10}


def test_assignment_is_least():
    rng = np.random.default_rng(1)
    assert assign(np.array([[4.0, 1, 3], [2, 0, 5], [3, 2, 2]])) == [(0, 1), (1, 0), (2, 2)]
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        cost = rng.integers(0, 20, (n, m)).astype(float)
        small = cost if n <= m else cost.T
        least = min(sum(small[i, c] for i, c in enumerate(p)) for p in permutations(range(small.shape[1]), small.shape[0]))
        assert sum(cost[r, c] for r, c in assign(cost)) == least


def test_gate_keeps_pairs_under_it(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 5.0), (1, 1, 2, 50.0), (1, 2, 1, 6.0), (1, 2, 2, 90.0)], "g int, a int, b int, cost double")
    assert {(r.a, r.b) for r in M.least_cost(pairs, "g", 10.0).collect()} == {(1, 1)}
    assert {(r.a, r.b, r.stage) for r in M.two_stage(pairs, "g", 10.0).collect()} == {(1, 1, 1), (2, 2, 2)}


def test_suppression_leaves_no_overlap(spark):
    rng = np.random.default_rng(2)
    b = rng.random((40, 2)) * 50
    rows = [(1, i, float(rng.random()), float(x), float(y), float(x + 12), float(y + 9)) for i, (x, y) in enumerate(b)]
    boxes = spark.createDataFrame(rows, "f int, det_id int, score double, l double, t double, r double, b double")
    kept = {r.det_id for r in M.non_maximum(boxes, "f", "score", 0.3).collect()}
    at = {r[1]: np.array(r[3:]) for r in rows}
    score = {r[1]: r[2] for r in rows}
    iou = lambda i, j: box_iou(at[i][None], at[j][None])[0, 0]
    assert all(iou(i, j) <= 0.3 for i in kept for j in kept if i < j)
    assert all(any(iou(i, j) > 0.3 and score[j] > score[i] for j in kept) for i in at.keys() - kept)


def test_rotated_overlap():
    square = np.array([[1, 1], [1, -1], [-1, -1], [-1, 1]], float)
    turned = square @ np.array([[1, 1], [-1, 1]]) / 2**0.5
    assert abs(figure_iou(square, square) - 1) < 1e-9
    both = 8 * (2**0.5 - 1)
    assert abs(figure_iou(square, turned) - both / (8 - both)) < 1e-9


def test_filter_equals_matrices():
    """The recurrences against the textbook's matrices."""
    rng = np.random.default_rng(3)
    f, h = np.eye(7), np.eye(4, 7)
    f[[0, 1, 2], [4, 5, 6]] = 1
    q, r = np.diag([*NOISE["q"], *NOISE["q_speed"]]), np.diag(NOISE["r"])
    x, p = np.array([5.0, 6, 100, 0.5, 0, 0, 0]), np.diag([NOISE["p"]] * 4 + [NOISE["p_speed"]] * 3)
    own = BoxFilter(x[:4])
    for _ in range(20):
        z = np.array([5.0, 6, 100, 0.5]) + rng.normal(size=4)
        x, p = f @ x, f @ p @ f.T + q
        k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
        x, p = x + k @ (z - h @ x), (np.eye(7) - k @ h) @ p
        own.predict()
        own.update(z)
        assert np.allclose(own.value, x[:4]) and np.allclose(own.speed, x[4:])


def moving(n=12):
    """Two boxes that move apart, and one that is seen once."""
    rows = [("v", f, d, 0.9, 10.0 + s * f, 10.0 + d * 100, 50.0 + s * f, 40.0 + d * 100) for f in range(n) for d, s in ((0, 2), (1, -1))]
    return [*rows, ("v", 7, 2, 0.9, 500.0, 500.0, 520.0, 520.0)]


BOX = "video_id string, frame_index long, det_id int, score double, l double, t double, r double, b double"


def test_tracker_keeps_identities(spark):
    got = K.track(spark.createDataFrame(moving(), BOX)).collect()
    ids = {d: {r.track_id for r in got if r.det_id == d} for d in (0, 1, 2)}
    assert len(ids[0]) == len(ids[1]) == 1 and ids[0] != ids[1] and not ids[2]
    assert len({(r.frame_index, r.track_id) for r in got}) == len(got)


def test_sources(spark, tmp_path):
    from lanewise.sources import annotations as A

    (tmp_path / "a.srt").write_text("1\n00:00:00,000 --> 00:00:00,040\n2023-11-05 18:20:03,120,009\n\n2\n00:00:00,040 --> 00:00:00,080\n2023-11-05 18:20:03,160,009\n")
    got = A.subtitles(spark, [str(tmp_path / "a.srt")]).orderBy("block").collect()
    assert [(r.block, r.unix_ms) for r in got] == [(1, 1699208403120), (2, 1699208403160)]
    (tmp_path / "r.json").write_text('{"shapes": [{"label": "lane_1", "points": [[0, 1], [2.5, 3]]}, {"label": "x", "points": [[1, 1]]}]}')
    got = A.shapes(spark, [str(tmp_path / "r.json")]).orderBy("shape_no").collect()
    assert [(r.kind, len(r.points), r.points[-1].x) for r in got] == [("lane", 2, 2.5), ("x", 1, 1.0)]
    (tmp_path / "g.csv").write_text("a,b\n\nb,c\na,b\n")
    assert {tuple(r) for r in A.video_graph(spark, [str(tmp_path / "g.csv")]).collect()} == {("a", "b"), ("b", "c")}
    base, own = ([("x", "1"), ("y", "2")], [("y", "3")])
    frame = lambda rows: spark.createDataFrame(rows, "key string, value string")
    assert {tuple(r) for r in A.merged_settings(frame(own), frame(base)).collect()} == {("x", "1"), ("y", "3")}


def test_suppress_order():
    overlap = np.array([[1, 0.5, 0], [0.5, 1, 0.5], [0, 0.5, 1]])
    assert suppress(np.array([0, 1, 2]), overlap, 0.3).tolist() == [True, False, True]


def test_known_figures_equal_general_ones(spark):
    ring, line = [(0, 0), (8, 1), (9, 7), (4, 3), (1, 8)], [(0.0, 0.0), (5.0, 5.0), (9.0, 2.0)]
    grid = spark.range(400).select((F.col("id") % 20 / 2).alias("x"), (F.floor(F.col("id") / 20) / 2).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    a, b = G.project_on_line(x, y, G.polygon(line)), G.project_on_known_line(x, y, line)
    rows = grid.select(G.inside(x, y, G.polygon(ring)).alias("i"), G.inside_ring(x, y, ring).alias("j"), a.alias("a"), b.alias("b")).collect()
    assert sum(r.i for r in rows) > 20 and all(r.i == r.j for r in rows)
    assert all(np.allclose([r.a.dist, r.a.pos, r.a.side], [r.b.dist, r.b.pos, r.b.side]) for r in rows)


def test_trajectories_travel_once_while_a_task_holds_them(spark):
    """Each side is copied for each block of the other: 5,000 vehicles of a point are one block."""
    side = lambda name: spark.range(5000).select(F.col("id").alias(name), F.col("id").alias("frame_index"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(0).alias("lane_id"))
    assert T._dealt(side("a"), side("b")).count() == 10000
