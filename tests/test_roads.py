"""Roads as tables against one polygon at a time, and maps from pairs with outliers."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.functions import geometry as G
from lanewise.operators import consensus, road_tables as R

POINT = "struct<x:double,y:double>"


def star(rng, x, y, n):
    """A ring around (x, y) that may be far from convex."""
    return [(float(x + r * math.cos(a)), float(y + r * math.sin(a))) for a, r in zip(np.sort(rng.uniform(0, 2 * math.pi, n)), rng.uniform(3, 40, n), strict=True)]


@pytest.fixture(scope="module")
def roads(spark):
    """Rings of five videos, some with corners on cells' corners, and points inside, outside, on edges and on corners."""
    rng = np.random.default_rng(31)
    rings = [(v, o, 10 * v + o, star(rng, *rng.uniform(0, 120, 2), int(rng.integers(3, 12)))) for v in range(4) for o in range(6)]
    rings += [(4, 0, 40, [(0, 0), (16, 0), (16, 16), (0, 16)]), (4, 1, 41, [(8, 8), (24, 8), (24, 24), (8, 24)]), (4, 2, 42, [(-20, -20), (-4, -20), (-12, 30)]), (4, 3, 43, [(1, 1), (2, 2)])]
    points = [(int(v), float(x), float(y)) for v, x, y in zip(rng.integers(0, 6, 3000), rng.uniform(-30, 160, 3000), rng.uniform(-30, 160, 3000), strict=True)]
    points += [(4, float(x), float(y)) for x in range(-24, 32, 4) for y in range(-24, 36, 4)]
    for v, _, _, ring in rings:
        points += [(v, float(x), float(y)) for x, y in ring] + [(v, (a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(ring, ring[1:], strict=False)]
    points += [(0, None, 1.0), (0, float("nan"), 1.0), (None, 5.0, 5.0)]
    lanes = spark.createDataFrame([(v, o, n, [(float(x), float(y)) for x, y in ring]) for v, o, n, ring in rings], f"video_id int, ord int, lane int, ring array<{POINT}>")
    return spark.createDataFrame([(i, v, *(None if c is None else float(c) for c in p)) for i, (v, *p) in enumerate(points)], "id int, video_id int, x double, y double"), lanes


def one_by_one(points, lanes):
    """The first polygon that holds a point, by a join of each with each."""
    both = points.join(lanes.filter(F.size("ring") > 2), "video_id").filter(~F.isnan("x") & G.inside(F.col("x"), F.col("y"), F.col("ring")))
    return {r.id: r.lane for r in both.groupBy("id").agg(F.min_by("lane", "ord").alias("lane")).collect()}


@pytest.mark.parametrize("size", [4.0, 32.0, 500.0])
def test_lanes_equal_one_polygon_at_a_time(spark, roads, size):
    points, lanes = roads
    want = one_by_one(points, lanes)
    got = R.lanes_from_table(points, lanes, size=size).collect()
    assert len(got) == points.count() and {r.id: r.lane for r in got if r.lane != -1} == want
    assert len(want) > 400


@pytest.mark.parametrize("many", [R.MANY, 5])
def test_roads_of_many_edges_go_by_cells(spark, roads, monkeypatch, many):
    points, lanes = roads
    want = one_by_one(points, lanes)
    monkeypatch.setattr(R, "EDGES", 0)
    got = R.lanes_from_table(points, lanes, size=16.0, many=many)
    assert "cell_x" in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.lane for r in got.collect() if r.lane != -1} == want


def test_roads_are_never_broadcast(spark, roads, tmp_path):
    """Their estimated size is that of the small file that they come from."""
    points, lanes = roads
    lanes.write.parquet(str(tmp_path / "lanes"))
    lanes = spark.read.parquet(str(tmp_path / "lanes"))
    regions = lanes.withColumns({"points": F.slice("ring", 1, 2), "base": F.lit(0.0), "start": F.lit(0.0), "per_pixel": F.lit(1.0)})
    for out in (R.lanes_from_table(points, lanes), R.along_lines_from_table(points, regions)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("many", [R.MANY, 5])
def test_places_along_lines_by_video_and_by_cells(spark, roads, monkeypatch, many):
    points, lanes = roads
    regions = lanes.withColumns({"points": F.slice("ring", 1, 3), "base": F.lit(2.0), "start": F.col("lane") * 100.0, "per_pixel": F.lit(0.5)})
    found = []
    for edges in (R.EDGES, 0):
        monkeypatch.setattr(R, "EDGES", edges)
        rows = R.along_lines_from_table(points, regions, many=many).select("id", "lane", "line_pos", "line_offset").collect()
        found.append({r.id: tuple(r)[1:] for r in rows})
        assert len(rows) == points.count()
    assert found[0].keys() == found[1].keys() and sum(v[0] is not None for v in found[0].values()) > 400
    for k, v in found[0].items():
        assert v == found[1][k] if v[0] is None else v[0] == found[1][k][0] and np.allclose(v[1:], found[1][k][1:], rtol=0, atol=1e-9)


def test_heavy_cells_are_split(spark, roads, monkeypatch):
    points, lanes = roads
    monkeypatch.setattr(R, "HEAVY", 10**9)
    cover = R.cell_cover(lanes, size=32.0)
    keyed = points.withColumns({"cell_x": F.floor(F.col("x") / 32), "cell_y": F.floor(F.col("y") / 32)})
    joined = R.salted_join(keyed, cover, ["video_id", "cell_x", "cell_y"], many=5)
    assert "_salt" in joined._jdf.queryExecution().optimizedPlan().toString()
    want = {r.id: r.lane for r in R.lanes_from_table(points, lanes, size=32.0).collect()}
    assert {r.id: r.lane for r in R.lanes_from_table(points, lanes, size=32.0, many=5).collect()} == want


def test_cells_inside_need_no_test(spark, roads):
    _, lanes = roads
    cover = R.cell_cover(lanes.filter("lane = 40"), size=2.0)
    kinds = {r.inner: r["count"] for r in cover.select(F.get("entries", F.lit(0)).edges.isNull().alias("inner")).groupBy("inner").count().collect()}
    assert kinds[True] == 36  # of 8 x 8 cells all but those at the border; cells beyond touch it as well


def test_plans_hold_no_nested_loop(spark, roads):
    points, lanes = roads
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = R.lanes_from_table(points, lanes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_lines_and_places_along_them(spark):
    lines = spark.createDataFrame([(v, n, [(0.0, 10.0 * n + v), (100.0, 10.0 * n + v)]) for v in (0, 1) for n in (1, 2, 4)] + [(2, 1, [(0.0, 0.0), (1.0, 0.0)])], f"video_id int, number int, points array<{POINT}>")
    points = spark.createDataFrame([(0, 5.0, 14.0), (0, 5.0, 36.0), (1, 50.0, 14.0), (2, 1.0, 1.0), (3, 1.0, 1.0)], "video_id int, x double, y double")
    got = {(r.video_id, r.y): r.lane for r in R.between_lines_from_table(points, lines).collect()}
    assert got == {(0, 14.0): 1, (0, 36.0): -1, (1, 14.0): 1, (2, 1.0): -1, (3, 1.0): -1}
    strips = R.lanes_from_table(points, R.strips_as_polygons(lines))
    assert {(r.video_id, r.y): r.lane for r in strips.collect()} == {(0, 14.0): 1, (0, 36.0): -1, (1, 14.0): 1, (2, 1.0): -1, (3, 1.0): -1}
    regions = lines.filter("number < 4").select("video_id", F.col("number").alias("ord"), F.col("number").alias("lane"), F.array(*[G.point(x, F.lit(y)) for x, y in ((F.lit(0.0), 0.0), (F.lit(60.0), 0.0), (F.lit(60.0), 60.0), (F.lit(0.0), 60.0))]).alias("ring"), "points", F.lit(2.0).alias("base"), F.lit(100.0).alias("start"), F.lit(0.5).alias("per_pixel"))
    along = {(r.video_id, r.y): (r.lane, r.line_pos, r.line_offset) for r in R.along_lines_from_table(points, regions).collect()}
    assert along == {(0, 14.0): (1, 101.5, 2.0), (0, 36.0): (1, 101.5, 13.0), (1, 14.0): (1, 124.0, 1.5), (2, 1.0): (1, 99.5, 0.5), (3, 1.0): (None, None, None)}


def planted(rng, n, wrong, turn, scale, tx, ty):
    x, y = rng.uniform(0, 1000, n), rng.uniform(0, 600, n)
    c, s = scale * math.cos(turn), scale * math.sin(turn)
    u, v = c * x - s * y + tx, s * x + c * y + ty
    bad = rng.permutation(n)[: int(wrong * n)]
    u[bad] += rng.uniform(20, 300, len(bad))
    v[bad] -= rng.uniform(20, 300, len(bad))
    return np.stack([x, y, u, v], 1), [c, -s, tx, s, c, ty]


@pytest.mark.parametrize("many", [consensus.MANY, 50])
def test_outliers_leave_maps_unchanged(spark, many):
    rng = np.random.default_rng(32)
    rows, want = [], {}
    for g, (n, wrong) in enumerate(((10, 0.4), (200, 0.4), (1000, 0.4), (40, 0.0), (3, 0.0), (500, 0.5))):
        values, want[g] = planted(rng, n, wrong, rng.uniform(-3, 3), rng.uniform(0.5, 2), *rng.uniform(-100, 100, 2))
        rows += [(g, i, *map(float, v)) for i, v in enumerate(values)]
    rows += [(7, i, 1.0, 1.0, float(i), 2.0) for i in range(5)] + [(8, 0, 1.0, 2.0, 3.0, 4.0), (1, 999, None, 1.0, 1.0, 1.0)]
    pairs = spark.createDataFrame(rows, "g int, k int, x double, y double, u double, v double")
    runs = [{r.g: (list(r.map), r.inliers) for r in consensus.robust_fits(pairs.repartition(p), ["g"], "k", many=many).collect()} for p in (1, 7)]
    assert set(runs[0]) == set(want) == set(runs[1])
    for g, m in want.items():
        for run in runs:
            assert np.abs(np.array(run[g][0]) - m).max() < 1e-6
    assert runs[0][1][1] == 120 and runs[0][2][1] == 600


def test_calibrated_maps(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (10.0, 10.0), (5.0, 7.0)]
    moved = [(x + 3, y - 4) for x, y in square]
    moved[4] = (90.0, 90.0)
    skewed = [(2 * x + y, 3 * y) for x, y in square[:3]]
    shapes = "scene int, shape_no int, label string, points array<struct<x:double,y:double>>"
    sub = spark.createDataFrame([(1, 0, "stitch_a", square), (2, 0, "stitch_a", square[:3]), (3, 0, "stitch_a", square[:2]), (4, 0, "other", square)], shapes)
    main = spark.createDataFrame([(1, 0, "lane_1", square), (1, 1, "stitch_a", moved), (2, 0, "stitch_a", skewed), (3, 0, "stitch_a", square), (4, 0, "stitch_a", square)], shapes)
    got = {r.scene: ([round(v, 6) for v in r.map], r.split_x) for r in consensus.calibrated_maps(main, sub, ["scene"], "stitch_").collect()}
    assert got == {1: ([1, 0, 3, 0, 1, -4], 90.0), 2: ([2, 1, 0, 0, 3, 0], 20.0)}
    first = {r.scene: [round(v, 6) for v in r.map] for r in consensus.calibrated_maps(main, sub, ["scene"], "stitch_", first_three=True).collect()}
    assert first == {1: [1, 0, 3, 0, 1, -4], 2: [2, 1, 0, 0, 3, 0]}


def test_chains_in_a_row_equal_chains_by_joins(spark):
    from lanewise.operators import roads

    rows = [("a", str(i), str(i + 1) if i < 5 else None, float(i + 1), i == 0) for i in range(6)]  # a chain from its base
    rows += [("b", "x", "y", 2.0, True), ("b", "y", "x", 3.0, False)]  # back to its base
    rows += [("c", "p", "q", 1.0, False), ("c", "q", None, 1.0, False)]  # no base
    rows += [("d", "only", None, 0.0, True)]
    parts = spark.createDataFrame(rows, "line string, position string, next string, length double, is_base boolean")
    got, want = ({(r.line, r.position): r.distance for r in way(parts).collect()} for way in (roads._along_rows, roads._along_tables))
    assert got == {("a", str(i)): i * (i + 1) / 2 for i in range(6)} | {("b", "x"): 0.0, ("b", "y"): 2.0, ("d", "only"): 0.0}
    assert {k: v for k, v in want.items() if k != ("b", "x")} == {k: v for k, v in got.items() if k != ("b", "x")}
