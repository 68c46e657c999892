"""Sinks that are written again, streams that are replayed, and the job from many videos to connected trajectories."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.operators import connect, trajectories
from lanewise.sources import sinks


def detections(spark, videos, frames, score):
    return spark.createDataFrame([(v, f, d, score) for v in videos for f in frames for d in range(2)], "video_id string, frame_index long, det_id int, score double")


def held(df):
    return sorted((r.video_id, r.frame_index, r.det_id, r.score) for r in df.collect())


@pytest.mark.parametrize("write", [sinks.write_detections, sinks.write_transforms])
def test_a_video_is_replaced_and_others_stay(spark, tmp_path, write):
    path = str(tmp_path / "out")
    write(detections(spark, "abc", range(50), 0.5), path)
    write(detections(spark, "b", range(20), 0.9), path)
    want = held(detections(spark, "ac", range(50), 0.5).unionByName(detections(spark, "b", range(20), 0.9)))
    assert held(spark.read.parquet(path)) == want
    assert all(len(list(p.glob("*.parquet"))) == 1 for p in (tmp_path / "out").glob("video_id=*"))


def test_a_long_video_is_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FRAMES", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_detections(detections(spark, "a", range(100), 0.5), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 1 < len(list((tmp_path / "out" / "video_id=a").glob("*.parquet"))) <= 10
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def test_replayed_and_broken_batches_count_once(spark, tmp_path):
    path = str(tmp_path / "out")
    write = sinks.detections_to(path)
    write(detections(spark, "ab", range(10), 0.5), 0)
    write(detections(spark, "b", range(10, 20), 0.5), 1)
    # A batch that failed after its rows were written, before it was listed: another driver replays it, with the same rows.
    detections(spark, "z", range(3), 0.1).write.partitionBy("video_id").parquet(f"{path}/batch=2")
    seen = held(sinks.read_batches(spark, path))
    assert seen == held(detections(spark, "ab", range(10), 0.5).unionByName(detections(spark, "b", range(10, 20), 0.5)))
    for _ in range(2):
        write(detections(spark, "a", range(10, 12), 0.7), 2)
        write(detections(spark, "b", range(10, 20), 0.5), 1)
    assert held(sinks.read_batches(spark, path)) == sorted(seen + held(detections(spark, "a", range(10, 12), 0.7)))


def test_a_stream_of_detections_is_written_once(spark, tmp_path):
    rows, path = detections(spark, "ab", range(30), 0.5), str(tmp_path / "out")
    for k in range(3):
        rows.filter(F.col("frame_index") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(sinks.detections_to(path)).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert held(sinks.read_batches(spark, path)) == held(rows)


def views(spark):
    """Three videos, 2 -> 1 -> 0, each seeing four vehicles from its own place and clock, and one vehicle that only the last sees."""
    rng = np.random.default_rng(51)
    rows, truth = [], {}
    for v in range(4):
        start = rng.uniform(0, 300, 2) + [0, 700 * v]
        for f in range(20, 60):
            truth[v, f] = start + np.array([5.0, 0.5]) * (f - 20)
    back = {0: lambda p: p, 1: lambda p: np.array([(p[0] - 50) / 2, (p[1] + 30) / 2]), 2: lambda p: back[1](p) @ np.array([[0, -1], [1, 0]]).T}
    for video in range(3):
        for (v, f), place in truth.items():
            x, y = back[video](place)
            rows.append((video, 10 * video + v, f - 4 * video, float(x), float(y), -1))
    rows += [(2, 99, f, 1e6 + f, 1e6, -1) for f in range(30)]
    points = spark.createDataFrame(rows, "video_id long, veh_id long, frame_index long, x double, y double, lane_id int")
    edges = spark.createDataFrame([(1, 0, 4, [2.0, 0.0, 50.0, 0.0, 2.0, -30.0]), (2, 1, 4, [0.0, 1.0, 0.0, -1.0, 0.0, 0.0])], "src long, dst long, shift int, map array<double>")
    clocks = spark.createDataFrame([(v, 0, 0.0, 40.0) for v in range(3)], "video_id long, first_frame int, start_ms double, delta_ms double")
    return points, edges, clocks, truth


def test_many_videos_become_connected_trajectories(spark, tmp_path, monkeypatch):
    points, edges, clocks, truth = views(spark)
    folder, made = f"file://{tmp_path}/job", []
    stages = connect.Stages.__call__

    def counted(self, name, make):
        before = len(self.made)
        out = stages(self, name, make)
        made.extend(self.made[before:])
        return out

    monkeypatch.setattr(connect.Stages, "__call__", counted)
    broken = monkeypatch.context()
    with broken as m:
        m.setattr(trajectories, "fused", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            connect.connected_trajectories(points, edges, clocks, 0, folder)
    assert set(made) == {"matches", "paths", "aligned", "clusters"}
    made.clear()
    got = connect.connected_trajectories(points, edges, clocks, 0, folder).collect()
    assert made == ["connected"]  # a new run takes up what the broken one has done
    made.clear()
    assert connect.connected_trajectories(points, edges, clocks, 0, folder).count() == len(got) and not made
    connect.connected_trajectories(points, edges, clocks, 0, folder, token="2")
    assert set(made) == {"matches", "paths", "aligned", "clusters", "connected"}
    by_id = {}
    for r in got:
        by_id.setdefault(r.id, []).append(r)
    assert sorted(by_id) == list(range(5))
    fused = {i: rows for i, rows in by_id.items() if rows[0].is_fused}
    assert len(fused) == 4 and sum(len(rows) for rows in fused.values()) == len(truth)
    for rows in fused.values():
        v = min(range(4), key=lambda k: math.dist(truth[k, rows[0].frame_index], (rows[0].x, rows[0].y)))
        assert all(np.allclose((r.x, r.y), truth[v, r.frame_index]) for r in rows)
