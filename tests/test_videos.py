"""Operators on many videos against plain Python."""
import json
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.functions import affine, geometry as G
from lanewise.functions.assignment import box_iou
from lanewise.functions.kalman import NOISE, HeightFilter, to_box, to_state
from lanewise.operators import connection as C, graphs, matching as M, raster, roads, tracking as K
from lanewise.sources import annotations as A, sinks


def test_long_chains(spark):
    n = 3000
    rows = [(i, i + 1 if i + 1 < n else None, 1.0 + i % 3, i == 0) for i in range(n)]
    rows += [(n + 1, n + 2, 1.0, False), (n + 2, n + 1, 1.0, False)]  # a circle that no base leads to
    got = {r.node: r.distance for r in graphs.distances(spark.createDataFrame(rows, "node int, next int, length double, is_base boolean")).collect()}
    run = np.concatenate([[0], np.cumsum([r[2] for r in rows[:n]])])
    assert got == {i: run[i] for i in range(n)}


def plain_paths(edges, root):
    seen, front, depth = {root: (0, 0.0)}, {root}, 0
    while front:
        depth += 1
        step = {}
        for s, d, shift in edges:
            if d in front and s not in seen:
                step[s] = min(step.get(s, np.inf), shift + seen[d][1])
        seen |= {s: (depth, v) for s, v in step.items()}
        front = set(step)
    return seen


def test_paths_on_cycles_and_long_ways(spark):
    dense = [(i, j, float(i * 7 + j)) for i in range(7) for j in range(7) if i != j]
    path = [(i + 10, i + 9, 1.0) for i in range(102)] + [(9, 0, 2.0)]
    edges = dense + path
    got = {r.node: (r.depth, r["shift"]) for r in graphs.paths_to_root(spark.createDataFrame(edges, "src int, dst int, shift double"), 0).collect()}
    assert got == plain_paths(edges, 0) and max(d for d, _ in got.values()) > 100


def test_clusters_equal_union_find(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(150)]
    label = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.cluster for r in graphs.clusters(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == label


def test_first_fit_is_not_transitive(spark):
    pairs = spark.createDataFrame([(0, 0, "A", "B"), (0, 1, "C", "D"), (0, 2, "B", "C")], "g int, at int, a string, b string")
    got = {}
    for r in graphs.first_fit_clusters(pairs, "at", "g").collect():
        got.setdefault(r.cluster_no, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [["A", "B", "C"], ["C", "D"]]


class PlainSort:
    """The tracker by overlap with the textbook's matrices and every assignment tried."""

    def __init__(self, max_age=5, min_hits=3, least=0.3):
        self.max_age, self.min_hits, self.least, self.tracks, self.n, self.next = max_age, min_hits, least, [], 0, 1
        self.f, self.h = np.eye(7), np.eye(4, 7)
        self.f[[0, 1, 2], [4, 5, 6]] = 1
        self.q, self.r = np.diag([*NOISE["q"], *NOISE["q_speed"]]), np.diag(NOISE["r"])

    def step(self, boxes):
        self.n += 1
        for t in self.tracks:
            if t["missed"]:
                t["streak"] = 0
            if t["x"][6] + t["x"][2] <= 0:
                t["x"][6] = 0
            t["x"], t["p"], t["missed"] = self.f @ t["x"], self.f @ t["p"] @ self.f.T + self.q, t["missed"] + 1
        iou = box_iou(boxes, np.array([to_box(t["x"][:4]) for t in self.tracks]).reshape(-1, 4))
        strong, pairs = iou > self.least, []
        if iou.size and strong.any() and strong.sum(0).max() == strong.sum(1).max() == 1:
            pairs = list(zip(*np.nonzero(strong), strict=True))
        elif iou.size:
            n, m = iou.shape
            ways = [list(zip(range(n), p, strict=False)) for p in permutations(range(m), n)] if n <= m else [[(i, j) for j, i in enumerate(p)] for p in permutations(range(n), m)]
            pairs = max(ways, key=lambda w: sum(iou[i, j] for i, j in w))
        pairs = [(d, k) for d, k in pairs if iou[d, k] >= self.least]
        for d, k in pairs:
            t = self.tracks[k]
            gain = t["p"] @ self.h.T @ np.linalg.inv(self.h @ t["p"] @ self.h.T + self.r)
            t["x"] = t["x"] + gain @ (to_state(boxes[d]) - self.h @ t["x"])
            t["p"] = (np.eye(7) - gain @ self.h) @ t["p"]
            t |= {"missed": 0, "streak": t["streak"] + 1}
        for d in sorted(set(range(len(boxes))) - {d for d, _ in pairs}):
            p = np.diag([NOISE["p"]] * 4 + [NOISE["p_speed"]] * 3)
            self.tracks.append({"id": self.next, "x": np.array([*to_state(boxes[d]), 0, 0, 0]), "p": p, "missed": 0, "streak": 0})
            self.next += 1
        out = [(t["id"], to_box(t["x"][:4])) for t in self.tracks if t["missed"] < 1 and (t["streak"] >= self.min_hits or self.n <= self.min_hits)]
        self.tracks = [t for t in self.tracks if t["missed"] <= self.max_age]
        return out


BOX = "video_id string, frame_index long, det_id int, score double, l double, t double, r double, b double"


def test_sort_equals_plain_python(spark):
    rng = np.random.default_rng(7)
    rows = []
    for video in "vw":
        at, speed = rng.random((4, 2)) * 120, rng.normal(size=(4, 2)) * 3
        for f in range(40):
            at += speed + rng.normal(size=(4, 2)) * 0.5
            for d in np.flatnonzero(rng.random(4) < 0.85):
                x, y = at[d]
                rows.append((video, f, int(d), float(rng.random()), float(x), float(y), float(x + 40), float(y + 30)))
    got = {}
    for r in K.track(spark.createDataFrame(rows, BOX), max_age=5).collect():
        got[r.video_id, r.frame_index, r.track_id] = (r.l, r.t, r.r, r.b)
    want = {}
    for video in "vw":
        plain = PlainSort()
        for f in range(40):
            boxes = [r for r in rows if r[0] == video and r[1] == f]
            boxes.sort(key=lambda r: (-r[3], r[2]))
            if boxes:
                want |= {(video, f, i): tuple(b) for i, b in plain.step(np.array([b[4:] for b in boxes]))}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


def test_height_filter_equals_matrices():
    rng = np.random.default_rng(8)
    f, h = np.eye(8), np.eye(4, 8)
    f[[0, 1, 2, 3], [4, 5, 6, 7]] = 1
    x = np.array([5.0, 6, 0.5, 40, 0, 0, 0, 0])
    spread = lambda k, place, pace: np.diag(np.array([place * k, place * k, 1e-2, place * k, pace * k, pace * k, 1e-5, pace * k]) ** 2)
    p = spread(40, 2 / 20, 10 / 160)
    own = HeightFilter(x[:4])
    for _ in range(15):
        z = np.array([5.0, 6, 0.5, 40]) + rng.normal(size=4) * [1, 1, 0.01, 1]
        x, p = f @ x, f @ p @ f.T + spread(x[3], 1 / 20, 1 / 160)
        s = h @ p @ h.T + np.diag(np.array([x[3] / 20, x[3] / 20, 1e-1, x[3] / 20]) ** 2)
        own.predict()
        gap = z - h @ x
        assert np.isclose(own.distance(z[None])[0], gap @ np.linalg.inv(s) @ gap)
        gain = p @ h.T @ np.linalg.inv(s)
        x, p = x + gain @ gap, p - gain @ s @ gain.T
        own.update(z)
        assert np.allclose(own.value, x[:4]) and np.allclose(own.speed, x[4:])


def test_deep_sort_finds_again_by_appearance(spark):
    rows = []
    for f in range(30):
        for d, (x, look) in enumerate(((10.0 + f, [1.0, 0.0]), (200.0 - f, [0.0, 1.0]))):
            if not (d == 0 and 10 <= f < 14) and not (d == 1 and f == 20):
                rows.append(("v", f, d, 0.9, x, 50.0, x + 30, 110.0, look))
    rows.append(("v", 5, 7, 0.9, 600.0, 600.0, 620.0, 640.0, [0.7, 0.7]))  # seen once: stays tentative
    rows.append(("v", 6, 8, 0.1, 700.0, 600.0, 720.0, 640.0, [0.7, 0.7]))  # below the least score
    got = K.track(spark.createDataFrame(rows, BOX + ", look array<double>"), method="deep_sort", feature="look", least_score=0.3, max_age=20).collect()
    ids = {d: {r.track_id for r in got if r.det_id == d} for d in (0, 1, 7, 8)}
    assert len(ids[0]) == len(ids[1]) == 1 and ids[0] != ids[1] and not ids[7] and not ids[8]
    frames = {d: {r.frame_index for r in got if r.det_id == d} for d in (0, 1)}
    assert min(frames[0]) == 2  # confirmed at the third hit
    assert 10 in frames[0] and 11 not in frames[0] and 14 in frames[0]  # reported through one missed frame, found again after four
    assert 20 in frames[1]


def test_deep_sort_matches_the_recent_first():
    """Two confirmed tracks of the same look: the one seen in the frame before gets the box."""
    t = K.DeepSort(max_age=30)
    look, far = np.array([[1.0, 0.0]]), np.array([0.0, 0.0, 40.0, 80.0])
    for _ in range(4):
        t.step(np.array([0, 1]), np.stack([far, far + 1]), np.repeat(look, 2, 0))
    a, b = sorted(x.id for x in t.tracks)
    t.step(np.array([0]), far[None], look)
    seen = next(x.id for x in t.tracks if x.missed == 0)
    t.step(np.array([0]), far[None], look)
    assert {seen} == {x.id for x in t.tracks if x.missed == 0} and {a, b} == {x.id for x in t.tracks}
    again = K.DeepSort(max_age=30).with_state(t.counters(), t.track_rows())
    assert [(x.id, x.hits, x.missed) for x in again.tracks] == [(x.id, x.hits, x.missed) for x in t.tracks]


def test_deep_sort_by_another_metric():
    """Two looks of one direction and unlike lengths: told apart by euclidean distance alone."""
    looks, boxes = np.array([[1.0, 0.0], [3.0, 0.0]]), np.array([[0.0, 0, 40, 80], [4.0, 0, 44, 80]])
    t = K.DeepSort(metric="euclidean", most_distance=0.5, most_iou_distance=0.0)
    for _ in range(4):
        t.step(np.array([0, 1]), boxes, looks)
    ids = {x.det_id: x.id for x in t.tracks}
    out = t.step(np.array([0, 1]), boxes, looks[::-1])
    assert {d: i for i, d, _ in out if d in (0, 1)} == {0: ids[1], 1: ids[0]}


def test_turned_tracker_keeps_angles(spark):
    rows = [("v", f, d, 0.9, 50.0 + s * f, 60.0 + 100 * d, 60.0, 20.0, 1.55 + 0.01 * f) for f in range(12) for d, s in ((0, 3), (1, -2))]
    out = K.track(spark.createDataFrame(rows, "video_id string, frame_index long, det_id int, score double, cx double, cy double, w double, h double, theta double"), method="sort_turned").collect()
    ids = {d: {r.track_id for r in out if r.det_id == d} for d in (0, 1)}
    assert len(ids[0]) == len(ids[1]) == 1 and ids[0] != ids[1]
    assert all(-np.pi / 2 <= r.theta < np.pi / 2 and abs(r.w - 60) < 2 and abs(r.h - 20) < 2 for r in out)
    for r in out:
        gap = (r.theta - (1.55 + 0.01 * r.frame_index) + np.pi / 2) % np.pi - np.pi / 2
        assert abs(gap) < 0.1


def test_association_and_oriented_matches(spark):
    rng = np.random.default_rng(9)
    dets, tracks = [], []
    for f in range(12):
        for i in range(4):
            x, y = rng.random(2) * (30 if f % 2 else 300)
            dets.append((f, i, float(x), float(y), float(x + 40), float(y + 30)))
            tracks.append((f, i + 10, float(x + 4), float(y - 3), float(x + 44), float(y + 27)))
    d = spark.createDataFrame(dets, "frame_index int, det_id int, l double, t double, r double, b double")
    t = spark.createDataFrame(tracks, "frame_index int, track_id int, l double, t double, r double, b double")
    got = M.associated(d, t, "frame_index", 0.3)
    pairs = {}
    for r in got["pairs"].collect():
        pairs.setdefault(r.frame_index, set()).add((r.det_id, r.track_id))
    for f in range(12):
        p, q = (np.array([x[2:] for x in rows if x[0] == f]) for rows in (dets, tracks))
        iou = box_iou(p, q)
        strong = iou > 0.3
        best = max(permutations(range(4)), key=lambda w: sum(iou[i, j] for i, j in enumerate(w)))
        want = {(i, j + 10) for i, j in enumerate(best)} if not (strong.any() and strong.sum(0).max() == strong.sum(1).max() == 1) else {(i, j + 10) for i, j in zip(*np.nonzero(strong), strict=True)}
        assert pairs.get(f, set()) == {(i, j) for i, j in want if iou[i, j - 10] >= 0.3}
    assert got["new"].count() == len(dets) - got["pairs"].count() and got["lost"].count() == len(tracks) - got["pairs"].count()
    figures = d.withColumn("corners", F.array("r", "t", "r", "b", "l", "b", "l", "t")).select("frame_index", "det_id", "corners")
    out = M.oriented_matches(t, figures).collect()
    assert {(r.frame_index, r.det_id, r.track_id) for r in out} >= {(f, a, b) for f, s in pairs.items() for a, b in s}
    assert all((r.iou > 0.9) == (r.corners[0] == next(x for x in tracks if x[0] == r.frame_index and x[1] == r.track_id)[4]) for r in out)


def test_maps_are_applied_once(spark):
    p = spark.createDataFrame([("a", 1.0, 2.0, 9.0), ("b", 3.0, 4.0, 9.0)], "video_id string, x double, y double, line_pos double")
    m = spark.createDataFrame([("a", [0.0, -1.0, 5.0, 1.0, 0.0, 6.0])], "video_id string, map array<double>")
    twice = C.mapped(C.mapped(p, m, ["video_id"]), m, ["video_id"]).orderBy("video_id").collect()
    assert [(r.x, r.y, r.x_raw, r.line_pos) for r in twice] == [(3.0, 7.0, 1.0, None), (3.0, 4.0, 3.0, None)]
    back = p.select(affine.composed(affine.inverse(F.array(*[F.lit(v) for v in (2.0, 1.0, 3.0, -1.0, 1.0, 4.0)])), F.array(*[F.lit(v) for v in (2.0, 1.0, 3.0, -1.0, 1.0, 4.0)])).alias("m")).first().m
    assert np.allclose(back, affine.SAME)


def offsets_by_hand(means, order):
    """The search over offsets as a loop."""
    best = None
    for o in order:
        m = means.get(o)
        stop = best is not None and o * best[1] > 0 and best[0] < 100 and m is not None and m > max(2 * best[0], 100)
        if m is not None and (best is None or m < best[0]):
            best = (m, o)
        if stop:
            break
    return best and best[1]


def test_offset_search_stops_as_a_loop_does(spark):
    rng = np.random.default_rng(10)
    rows, want = [], {}
    order = [0] + [s * k for k in range(1, 8) for s in (1, -1)]
    for edge in range(40):
        means = {o: float(rng.choice([20, 60, 90, 150, 300, 800]) + rng.random()) for o in order if rng.random() < 0.9}
        rows += [(edge, o, 3, means.get(o), i + 1) for i, o in enumerate(order)]
        want[edge] = offsets_by_hand(means, order)
    got = {r.edge: r.offset for r in C.best_offsets(spark.createDataFrame(rows, "edge int, offset int, n long, mean double, place int")).collect()}
    assert got == want


def test_offset_is_found_and_edges_report(spark):
    rng = np.random.default_rng(11)
    a, b = [], []
    for edge in (0, 1):
        for v in range(4):
            x, y = rng.random(2) * 300
            for f in range(20):
                a.append((edge, v, f + 4, float(x + 9 * f), float(y + 2 * f), 1))
                b.append((edge, v + 50, f + 4 + (2 if edge else -1), float(x + 9 * f), float(y + 2 * f), 1))
    columns = "edge int, {} int, frame_index long, x double, y double, lane_id int"
    left, right = spark.createDataFrame(a, columns.format("a")), spark.createDataFrame(b, columns.format("b"))
    best = {r.edge: (r.offset, r.n, r.mean) for r in C.best_offsets(C.offset_quality(left, right, 3)).collect()}
    assert best == {0: (1, 4, 0.0), 1: (-2, 4, 0.0)}
    edges = spark.createDataFrame([(e, list(affine.SAME)) for e in (0, 1)], "edge int, map array<double>")
    clock = spark.createDataFrame([(0, 0, 0.0, 40.0, 1.0), (1, 0, 0.0, 40.0, -2.0)], "edge int, first_frame int, start_ms double, delta_ms double, offset double")
    out = C.edge_matches(left, right, edges, clock, clock.withColumn("offset", F.lit(0.0)))
    assert {(r.edge, r.n, r.mean) for r in out["quality"].collect()} == {(0, 4, 0.0), (1, 4, 0.0)}
    assert all(r.b == r.a + 50 for r in out["matches"].collect()) and out["rest_main"].count() == 0
    tables = C.match_tables(out["matches"], out["rest_main"], out["rest_sub"])
    assert {(r.edge, r.main_ids, r.sub_ids) for r in tables["match_"].collect()} == {(e, "0;1;2;3", "50;51;52;53") for e in (0, 1)}


def test_settings_and_clocks(spark, tmp_path):
    (tmp_path / "base.json").write_text("﻿" + json.dumps({"fps": 25, "detection": "d.json"}))
    (tmp_path / "d.json").write_text(json.dumps({"model": "m"}))
    (tmp_path / "own.json").write_text(json.dumps({"base": "base.json", "fps": 30}))
    (tmp_path / "flat.json").write_text(json.dumps({"fps": 5, "detection": "d.json"}))
    assert A.settings(spark, str(tmp_path / "own.json")) == {"fps": 30, "detection": "d.json"}
    assert A.settings(spark, str(tmp_path / "flat.json")) == {"fps": 5, "detection": {"model": "m"}}
    assert {(r.key, r.value) for r in A.many_video_settings(spark, [str(tmp_path / "flat.json")]).collect()} == {("fps", "5"), ("detection", "d.json")}
    (tmp_path / "1.srt").write_text("﻿1\r\n00:00 --> 00:01\r\n2024-03-01 00:00:01,250,000\r\n\r\n2\r\n00:01 --> 00:02\r\nno clock\r\n")
    (tmp_path / "2.srt").write_text("1\n00:00 --> 00:01\n2024-03-01 00:00:02,500,000\n")
    got = A.subtitles(spark, [str(tmp_path / "1.srt")]).orderBy("place").collect()
    assert [(r.block, r.unix_ms) for r in got] == [(1, 1709251201250), (2, None)]
    parts = [("v", 1, str(tmp_path / "1.srt")), ("v", 2, str(tmp_path / "2.srt")), ("w", 1, str(tmp_path / "2.srt")), ("w", 2, str(tmp_path / "missing.srt"))]
    clock = A.video_clock(spark, spark.createDataFrame(parts, "video_id string, part_no int, path string")).orderBy("video_id", "frame_index").collect()
    assert [(r.video_id, r.frame_index, r.unix_ms) for r in clock] == [("v", 0, 1709251201250), ("v", 1, None), ("v", 2, 1709251202500)]


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(k * 10 + 3, f, float(k)) for k in (5, 2, 9) for f in (1, 0)], "id long, frame_index long, x double")
    sinks.write_connected(rows, str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "c")).collect()
    assert {(r.id, r.frame_index, r.x) for r in got} == {(i, f, x) for i, x in enumerate((2.0, 5.0, 9.0)) for f in (0, 1)}
    boxes = spark.createDataFrame([("v", 0, 1.0), ("w", 3, 2.0)], "video_id string, frame_index long, l double")
    sinks.write_detections(boxes, str(tmp_path / "d"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "d")).select("video_id", "frame_index", "l").collect()} == {("v", 0, 1.0), ("w", 3, 2.0)}
    table = spark.createDataFrame([("e", "1;2", "3;4")], "edge string, main_ids string, sub_ids string")
    sinks.write_match_tables({"match_": table}, str(tmp_path / "m"), "a", "b")
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "m" / "match_a_b"), header=True).collect()] == [("e", "1;2", "3;4")]
    lines = spark.createDataFrame([("i", "c1 0.5 1 2 3 4")], "image string, line string")
    sinks.write_detection_lines(lines, str(tmp_path / "t"), "image")
    assert spark.read.text(str(tmp_path / "t")).first().value == "c1 0.5 1 2 3 4"
    for write, df in ((sinks.write_transforms, spark.createDataFrame([("v", 0, [1.0])], "video_id string, frame_index long, map array<double>")), (sinks.write_node_maps, spark.createDataFrame([("v", 0, 0.0, [1.0])], "node string, depth int, shift double, map array<double>"))):
        write(df, str(tmp_path / write.__name__))
        assert sorted(map(str, spark.read.parquet(str(tmp_path / write.__name__)).select(*df.columns).collect())) == sorted(map(str, df.collect()))


def test_background_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(0, f, y, x, (f * 7 + y + x) % 5) for f in range(6) for y in range(3) for x in range(3)], "scene int, frame long, y int, x int, v int")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = raster.background_stream(source, ["scene"], "frame", 4).writeStream.format("memory").queryName("bg").outputMode("complete").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.y, r.x): r["mean"] for r in raster.background(rows, rows, ["scene"], "frame", 4).collect()}
    assert {(r.y, r.x): r["mean"] for r in spark.table("bg").collect()} == pytest.approx(want)


def test_axis_ticks_have_no_limit(spark):
    s = spark.createDataFrame([(0.0, 0.0)], "ox double, oy double")
    assert roads.axis_ticks(s, F.lit(1.0), (1.0, 0.0), F.lit(5000), F.lit(10)).count() == 5000


def test_masks_hold_their_edges(spark):
    ring = [(1.9, 1.2), (6.5, 1.7), (6.1, 5.9), (1.3, 5.2)]
    grid = spark.range(64).select((F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"))
    got = {(r.x, r.y) for r in raster.masked(grid, F.array(G.polygon(ring))).collect()}
    assert got == {(x, y) for x in range(1, 7) for y in range(1, 6)}


def test_detectors_are_chosen_by_name(spark):
    import pyarrow as pa

    from lanewise.operators import detection as D

    @D.detector("bright")
    def bright(batches):
        for b in batches:
            rows = [r for r in b.to_pylist() if r["v"] > 3]
            yield pa.RecordBatch.from_pydict({"frame_index": pa.array([r["frame_index"] for r in rows], pa.int64()), "score": pa.array([r["v"] / 10 for r in rows], pa.float64())})

    frames = spark.createDataFrame([(f, f) for f in range(6)], "frame_index long, v int")
    assert sorted(map(tuple, D.detect(frames, "bright", "frame_index long, score double").collect())) == [(4, 0.4), (5, 0.5)]

    def length(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[float(v)] for v in b.column(1).to_pylist()], pa.list_(pa.float64()))], [*b.schema.names, "feature"])

    D.EXTRACTORS["value"] = length
    assert [r.feature for r in D.with_features(frames, "value").orderBy("frame_index").collect()] == [[float(v)] for v in range(6)]
