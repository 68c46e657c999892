"""From the points of many videos and the graph between them to connected trajectories: one job in stages, each a table that a later run finds."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators import connection as C, graphs, trajectories as T
from lanewise.sources.sinks import renumbered


class Stages:
    """Tables of a job in a folder that all executors share. A stage counts as done when its mark, written after the table, holds the run's token: what a failed run left half done is made again."""

    def __init__(self, spark: SparkSession, folder: str, token: str) -> None:
        self.spark, self.folder, self.token = spark, folder.rstrip("/"), token
        self.made: list[str] = []

    def __call__(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path, mark = f"{self.folder}/{name}", f"{self.folder}/{name}.done"
        if not self._marked(mark):
            make().write.mode("overwrite").parquet(path)
            self.spark.range(1).select(F.lit(self.token)).coalesce(1).write.mode("overwrite").text(mark)
            self.made.append(name)
        return self.spark.read.parquet(path)

    def _marked(self, mark: str) -> bool:
        try:
            return self.spark.read.text(mark).filter(F.col("value") == self.token).count() == 1
        except AnalysisException:
            return False


def node_of(video: str | Column, vehicle: str | Column) -> Column:
    """A vehicle of a video as one name."""
    return F.concat_ws("|", F.col(video) if isinstance(video, str) else video, F.col(vehicle) if isinstance(vehicle, str) else vehicle)


def connected_trajectories(
    points: DataFrame, edges: DataFrame, clocks: DataFrame, root: object, folder: str, token: str = "1", region: Column | None = None, similarity: C.Similarity = C.similar
) -> DataFrame:
    """id (from 0), frame_index, x, y, lane_id, is_fused: every vehicle of every video once, in the root's plane and frame numbers.

    points: video_id, veh_id, frame_index, x, y, lane_id; edges: src, dst, shift (frames that src is behind dst), map (from src's plane to dst's); clocks: video_id, first_frame, start_ms, delta_ms.

    Stages in folder: `matches` (edge by edge, all at once), `paths` (to the root), `clusters` (vehicles that matches connect), `aligned`, `connected`. A run with the same token takes up the stages that
    are done; another token begins anew. Vehicles of videos without a way to the root are left out.
    """
    stage = Stages(points.sparkSession, folder, token)
    edges = edges.withColumn("edge", F.concat_ws(">", "src", "dst"))

    def matches() -> DataFrame:
        side = lambda end, key: points.join(edges.select("edge", F.col(end).alias("video_id")), "video_id").select("edge", F.col("veh_id").alias(key), "frame_index", "x", "y", "lane_id")
        clock = lambda end: edges.select("edge", F.col(end).alias("video_id"), F.col("shift").alias("offset")).join(clocks, "video_id").drop("video_id")
        found = C.edge_matches(side("dst", "a"), side("src", "b"), edges.select("edge", "map"), clock("src"), clock("dst"), region, similarity)["matches"]
        return found.join(edges.select("edge", "src", "dst"), "edge")

    def clusters() -> DataFrame:
        good = stage("matches", matches).filter("accepted")
        return graphs.clusters(good.select(node_of("dst", "a").alias("a"), node_of("src", "b").alias("b"))).withColumnRenamed("node", "veh_id")

    def aligned() -> DataFrame:
        paths = stage("paths", lambda: graphs.paths_to_root(edges.select("src", "dst", "shift", "map"), root))
        near = points.join(paths.select(F.col("node").alias("video_id")), "video_id", "left_semi")
        out = C.aligned(near, paths, clocks, clocks.filter(F.col("video_id") == F.lit(root)))
        return out.select(node_of("video_id", "veh_id").alias("veh_id"), "frame_index", "x", "y", "lane_id")

    def connected() -> DataFrame:
        rows, groups = stage("aligned", aligned), stage("clusters", clusters)
        every = T.with_unmatched(T.fused(rows, groups), rows, groups)
        return renumbered(every.withColumnRenamed("id", "_key"), "_key", "id").drop("_key").select("id", "frame_index", "x", "y", "lane_id", "is_fused")

    stage("matches", matches)
    return stage("connected", connected)
