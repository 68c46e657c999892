"""Filters over many keys, hulls and least rectangles, warped images and ticks against plain versions."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.functions import assignment, geometry as G, heads, kalman
from lanewise.operators import raster, roads, tracking


def test_turn_filter_equals_matrices():
    """The textbook's steps for one track, against many at once; yaws come a half or whole turn off."""
    rng = np.random.default_rng(41)
    f, h = np.eye(8), np.zeros((5, 8))
    f[[0, 1, 2], [3, 4, 5]] = 0.1
    h[range(5), [0, 1, 2, 6, 7]] = 1
    q = np.diag([0.5, 0.5, 0.3, 5, 5, 3, 1, 1]) ** 2
    r = np.diag([5, 5, math.radians(30), 10, 10]) ** 2
    tracks = rng.normal(size=(4, 5)) * [100, 100, 2, 20, 20]
    own = kalman.TurnFilter(tracks)
    xs = [h.T @ z for z in tracks]
    ps = [np.diag([100, 100, math.radians(30), 500, 500, math.radians(300), 5, 5]) ** 2 for _ in tracks]
    for _ in range(25):
        zs = tracks + rng.normal(size=tracks.shape) * [3, 3, 0.2, 1, 1] + rng.integers(-2, 3, (4, 1)) * [0, 0, 2 * math.pi, 0, 0]
        own.predict()
        own.update(zs)
        for k, z in enumerate(zs):
            x, p = f @ xs[k], f @ ps[k] @ f.T + q
            z = z.copy()
            z[2] = min((z[2] + 2 * math.pi * n for n in range(-9, 10)), key=lambda a: abs(a - x[2]))
            gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
            xs[k], ps[k] = x + gain @ (z - h @ x), (np.eye(8) - gain @ h) @ p
        assert np.allclose(own.value, xs) and np.allclose(own.cov, ps)


@pytest.mark.parametrize("make", [tracking.filtered, tracking.filtered_by_height, tracking.gated_by_height])
def test_filters_do_not_see_where_batches_end(spark, make):
    rng = np.random.default_rng(42)
    rows = [(k, f, *map(float, rng.uniform(1, 50, 4))) for k, n in enumerate((1, 40, 3, 17, 2, 100, 7)) for f in range(n)]
    df = spark.createDataFrame(rows, "k long, f long, a double, b double, c double, d double").repartition(3)
    want = {(r.k, r.f): tuple(r)[2:] for r in make(df, "k", "f", ["a", "b", "c", "d"]).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    try:
        got = {(r.k, r.f): tuple(r)[2:] for r in make(df, "k", "f", ["a", "b", "c", "d"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert len(want) == len(rows) - (7 if make is tracking.gated_by_height else 0)


def plain_hull(points):
    """Corners such that all other points lie on one side of the line to the next."""
    points = sorted(set(points))
    if len(points) < 3:
        return set(points)
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    out = set()
    for a in points:
        for b in points:
            sides = [cross(a, b, c) for c in points if c not in (a, b)]
            on = [c for c in points if c not in (a, b) and cross(a, b, c) == 0]
            between = lambda c, a=a, b=b: min(a, b) <= c <= max(a, b)
            if a != b and all(s >= 0 for s in sides) and all(between(c) for c in on):
                out |= {a, b}
    return out


def plain_area(points):
    best = math.inf
    for a in points:
        for b in points:
            n = math.hypot(b[0] - a[0], b[1] - a[1])
            if n:
                u, w = (b[0] - a[0]) / n, (b[1] - a[1]) / n
                along, across = [x * u + y * w for x, y in points], [y * u - x * w for x, y in points]
                best = min(best, (max(along) - min(along)) * (max(across) - min(across)))
    return 0.0 if best == math.inf else best


def test_hulls_and_least_rectangles_equal_brute_force(spark):
    rng = np.random.default_rng(43)
    sets = [[tuple(map(float, p)) for p in rng.integers(0, k, (n, 2))] for k in (2, 4, 30) for n in (1, 2, 3, 5, 9, 20) for _ in range(4)]
    sets += [[(float(i), float(2 * i)) for i in range(6)], [(3.0, 4.0)] * 5, [(0.0, 0.0), (0.0, 5.0), (0.0, 2.0)], [tuple(p) for p in rng.normal(size=(40, 2)).tolist()]]
    df = spark.createDataFrame(list(enumerate(sets)), "id int, points array<struct<x:double,y:double>>")
    for r in df.select("id", G.convex_hull(F.col("points")).alias("hull"), heads.least_rectangle_of(F.col("points")).alias("box")).collect():
        hull = [(p.x, p.y) for p in r.hull]
        assert len(hull) == len(set(hull)) and set(hull) == plain_hull(sets[r.id]), sets[r.id]
        turns = [(b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(hull, hull[1:] + hull[:1], hull[2:] + hull[:2], strict=True)]
        assert len(hull) < 3 or min(turns) > 0
        assert abs(r.box.w * r.box.h - plain_area(sets[r.id])) < 1e-6
        u, w = math.cos(r.box.theta), math.sin(r.box.theta)
        for x, y in sets[r.id]:  # the rectangle holds every point
            dx, dy = x - r.box.cx, y - r.box.cy
            assert abs(dx * u + dy * w) <= r.box.w / 2 + 1e-6 and abs(dy * u - dx * w) <= r.box.h / 2 + 1e-6
    assert spark.range(1).select(heads.least_rectangle_of(F.expr("cast(array() as array<struct<x:double,y:double>>)")).alias("b")).first().b is None


def test_smooth_warp_equals_a_plain_one(spark):
    rng = np.random.default_rng(44)
    image = rng.integers(0, 255, (9, 13)).astype(float)
    m = np.array([[1.3, 0.4, -2.0], [-0.2, 0.8, 3.0], [0, 0, 1]])
    pixels = spark.createDataFrame([(0, y, x, float(image[y, x])) for y in range(9) for x in range(13)], "img int, y int, x int, v double")
    images = spark.createDataFrame([(0, 18, 12, m[:2].ravel().tolist())], "img int, width int, height int, map array<double>")
    for border in (0.0, 100.0):
        got = {(r.y, r.x): r.v for r in raster.warped_smoothly(pixels, images.drop("map"), images.select("img", "map"), ["img"], border).collect()}
        assert len(got) == 18 * 12
        wide = np.full((40, 60), border)
        wide[15:24, 20:33] = image
        for (y, x), v in got.items():
            sx, sy, _ = np.linalg.solve(m, [x, y, 1])
            i, j = math.floor(sy), math.floor(sx)
            if -15 <= i < 24 and -20 <= j < 39:
                a, b = sy - i, sx - j
                p = wide[i + 15 : i + 17, j + 20 : j + 22]
                assert abs(v - ((1 - a) * ((1 - b) * p[0, 0] + b * p[0, 1]) + a * ((1 - b) * p[1, 0] + b * p[1, 1]))) < 1e-6


def test_ticks_of_many_lines(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 0.0), (10.0, 5.0)]), (2, [(0.0, 0.0), (3.0, 4.0)]), (3, [(1.0, 1.0)])], "v int, points array<struct<x:double,y:double>>")
    got = sorted((r.v, r.d, r.x, r.y) for r in roads.line_ticks(lines, ["v"], 4.0).collect())
    assert got == [(1, 0, 0, 0), (1, 4, 4, 0), (1, 8, 8, 0), (1, 12, 10, 2), (2, 0, 0, 0), (2, 4, pytest.approx(2.4), pytest.approx(3.2))]


def clipped_area(p, q):
    """p cut by each side of q."""
    area = lambda r: sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(r, r[1:] + r[:1], strict=True)) / 2 if r else 0.0
    q = q if area(q) > 0 else q[::-1]
    out = p
    for a, b in zip(q, q[1:] + q[:1], strict=True):
        side = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for c in out]
        now = []
        for (c, s), (d, t) in zip(zip(out, side, strict=True), list(zip(out, side, strict=True))[1:] + list(zip(out, side, strict=True))[:1], strict=True):
            if s >= 0:
                now.append(c)
            if (s < 0) != (t < 0):
                now.append((c[0] + s / (s - t) * (d[0] - c[0]), c[1] + s / (s - t) * (d[1] - c[1])))
        out = now
    return abs(area(out))


def test_shared_areas_equal_clipping():
    rng = np.random.default_rng(45)
    boxes = rng.uniform(0, 30, (600, 5)) * [1, 1, 1, 0.5, 0.2] + [0, 0, 1, 1, 0]
    boxes[::3, 4] = (np.arange(200) % 4) * math.pi / 2  # quarter turns: sides in line
    boxes[::5] = np.round(boxes[::5])
    p = kalman.corners_of(boxes)
    q = p[rng.permutation(600)]
    q[:50] = p[:50]  # the same
    q[50:100] = p[50:100, ::-1]  # the other way round
    q[100:150] = p[100:150] + 100  # apart
    got = assignment.shared_areas(p, q)
    for a, b, v in zip(p.tolist(), q.tolist(), got, strict=True):
        assert abs(v - clipped_area([tuple(c) for c in a], [tuple(c) for c in b])) < 1e-6
    assert np.allclose(got[:100], np.abs(assignment.areas(p[:100]))) and not got[100:150].any()
    assert assignment.figures_iou(p[:0], q[:0]).shape == (0,)


@pytest.mark.parametrize("held", [1 << 16, 300, 41])
def test_turned_videos_side_by_side_equal_one_at_a_time(spark, monkeypatch, held):
    """Videos of unlike length, with gaps, clutter and vehicles that cross, cut into batches anywhere."""
    rng = np.random.default_rng(43)
    rows = []
    for v, n in enumerate((60, 5, 90, 33, 1, 60, 200)):
        places, speeds = rng.uniform(0, 300, (5, 2)), rng.normal(0, 6, (5, 2))
        for f in range(n):
            seen = [k for k in range(5) if rng.random() < 0.7]
            for d, k in enumerate(seen or [0]):
                x, y = places[k] + f * speeds[k] % 200 + rng.normal(0, 2, 2)
                w, h = (140.0, 60.0) if k % 2 else (50.0, 90.0)
                rows.append((v, f * 2, d, float(-d), float(x), float(y), w, h, float(rng.normal(0.3 * k, 0.05))))
    boxes = spark.createDataFrame(rows, "video_id int, frame_index long, det_id int, score double, cx double, cy double, w double, h double, theta double").repartition(3)

    class Alone(tracking.SortTurned):
        """Not known to go side by side."""

    monkeypatch.setitem(tracking.TRACKERS, "alone", Alone)
    monkeypatch.setattr(tracking, "HELD", held)
    monkeypatch.setattr(tracking, "NARROW", 2 if held > 50 else 0)

    def rows_of(method):
        return sorted(tuple(r) for r in tracking.track(boxes, method=method, max_age=4).coalesce(1).collect())

    want = rows_of("alone")
    assert rows_of("sort_turned") == want and len(want) > 500


def test_few_frames_are_walked_alone():
    """Of nine videos those that outlast the others go on alone; all others' frames are taken together."""
    alone = []

    class Counted(tracking.SortTurned):
        def step(self, *a):
            alone.append(a)
            return super().step(*a)

    videos = [v for v in range(9) for _ in range(50 if v else 80)]
    boxes = np.tile([100.0, 100.0, 140.0, 100.0, 0.1], (len(videos), 1))
    (found,) = tracking.TurnedSideBySide(Counted()).walk(iter([(videos, np.arange(len(videos) + 1), np.ones(len(videos), np.int32), boxes)]))
    assert len(found[0]) == len(videos) and set(found[1]) == {1} and len(alone) == 30
