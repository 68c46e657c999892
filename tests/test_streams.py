"""Stateful streams equal batches: several batches, restarts, late frames, idle videos, a start from a batch's end."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.operators import connection, tracking
from lanewise.streaming import stabiliser
from lanewise.streaming.tracker import track_stream

BOX = "video_id string, frame_index long, det_id int, l double, t double, r double, b double, score double, feature array<double>, unix_ms double"
DAY = 1_700_000_000_000.0


def boxes(spark, frames=range(16)):
    """Three videos of crossing vehicles, one of which is hidden for a while; a box that comes once."""
    rows = []
    for v in range(3):
        for f in frames:
            places = [(0, 10.0 + 6 * f, 20.0 + v), (1, 120.0 - 6 * f, 24.0 + v), (2, 60.0, 80.0 + 3 * f)]
            for d, x, y in places:
                if not (d == 2 and 5 <= f <= 7):
                    rows.append((f"v{v}", f, d, x, y, x + 20, y + 12, 0.9 - d / 10, [math.cos(d), math.sin(d)], DAY + 40.0 * f))
            if f == 4:
                rows.append((f"v{v}", f, 9, 300.0, 300.0, 310.0, 310.0, 0.1, [0.0, 0.0], DAY + 40.0 * f))
    return spark.createDataFrame(rows, BOX)


class Fed:
    """A folder that a stream reads, one run for each batch: the query is started anew every time."""

    def __init__(self, spark, folder, make, **options):
        self.spark, self.folder, self.make, self.options = spark, folder, make, options

    def feed(self, rows):
        rows.coalesce(1).write.mode("append").parquet(str(self.folder / "in"))
        source = self.spark.readStream.schema(rows.schema).parquet(str(self.folder / "in"))
        query = self.make(source, **self.options).writeStream.format("parquet").option("checkpointLocation", str(self.folder / "state")).trigger(availableNow=True).start(str(self.folder / "out"))
        query.awaitTermination()

    def out(self):
        return self.spark.read.parquet(str(self.folder / "out"))


def tracked(df):
    return sorted((r.video_id, r.frame_index, r.track_id, r.det_id, round(r.l, 6), round(r.b, 6)) for r in df.collect())


@pytest.mark.parametrize("method", ["sort", "deep_sort"])
def test_tracks_of_a_stream_equal_a_batch(spark, tmp_path, rocksdb, method):
    rows, feature = boxes(spark), "feature" if method == "deep_sort" else None
    settings = {"budget": 4} if feature else {}
    fed = Fed(spark, tmp_path, track_stream, method=method, feature=feature, clock="unix_ms", delay="10 minutes", idle_ms=3_600_000, **settings)
    for lo, hi in ((0, 4), (6, 6), (7, 15)):
        fed.feed(rows.filter(F.col("frame_index").between(lo, hi)))
    fed.feed(rows.filter("frame_index = 5"))  # comes too late
    want = tracked(tracking.track(rows.filter("frame_index <> 5"), method=method, feature=feature, **settings))
    assert tracked(fed.out()) == want and len(want) > 60


def steps(spark, frames, videos=("a", "b")):
    rows = []
    for k, v in enumerate(videos):
        for f in frames:
            turn = 0.01 * (f % 5 + k)
            rows.append((v, f, [math.cos(turn), -math.sin(turn), 0.5 * f, math.sin(turn), math.cos(turn), k - 0.25 * f], DAY + 40.0 * f))
    return spark.createDataFrame(rows, "video_id string, frame_index long, map array<double>, unix_ms double")


def maps(df):
    return {(r.video_id, r.frame_index): np.round(r.map, 9).tolist() for r in df.collect()}


def test_maps_of_a_stream_equal_a_batch(spark, tmp_path, rocksdb):
    rows, options = steps(spark, range(60)), {"video": "video_id", "every": 7, "skip": [(20, 30)]}
    fed = Fed(spark, tmp_path, stabiliser.cumulated_stream, delay="10 minutes", idle_ms=3_600_000, **options)
    for lo, hi in ((0, 21), (23, 40), (41, 59), (22, 22)):
        fed.feed(rows.filter(F.col("frame_index").between(lo, hi)))
    assert maps(fed.out()) == maps(connection.cumulated(rows.filter("frame_index <> 22"), "video_id", 7, [(20, 30)]))


def test_a_stream_goes_on_from_a_batch(spark, tmp_path, rocksdb):
    rows = steps(spark, range(40))
    batch = connection.cumulated(rows.filter("frame_index < 25"), "video_id", 7, [(10, 16)])
    start = stabiliser.anchors_of(batch, "video_id", 7, [(10, 16)])
    fed = Fed(spark, tmp_path, stabiliser.cumulated_stream, video="video_id", every=7, skip=[(10, 16)], delay="10 minutes", idle_ms=3_600_000, initial=start)
    fed.feed(rows.filter("frame_index >= 25"))
    whole = maps(connection.cumulated(rows, "video_id", 7, [(10, 16)]))
    assert maps(fed.out()) == {k: m for k, m in whole.items() if k[1] >= 25}


def test_idle_videos_are_forgotten(spark, tmp_path, rocksdb):
    """b stops, a goes on for an hour; when b's name comes again it begins anew."""
    fed = Fed(spark, tmp_path, stabiliser.cumulated_stream, video="video_id", every=7, delay="1 second", idle_ms=60_000)
    fed.feed(steps(spark, range(20)))
    fed.feed(steps(spark, range(90_000, 90_010), ("a",)))
    fed.feed(steps(spark, range(180_000, 180_010), ("a",)))
    again = steps(spark, range(200_000, 200_003), ("b",))
    fed.feed(again)
    got = maps(fed.out())
    fresh = maps(connection.cumulated(again, "video_id", 7))
    assert {k: m for k, m in got.items() if k[1] >= 200_000} == fresh
