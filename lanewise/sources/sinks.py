"""What a run leaves behind: detections, transforms, maps to the main video, match tables and connected trajectories, as Parquet or CSV."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.tables import written


#: Frames of a video that lie in one file, and its most rows.
FRAMES, ROWS = 100_000, 5_000_000


def _by_video(rows: DataFrame, video: str, order: str | None, *more: str) -> DataFrameWriter:
    """A writer of a folder a video that replaces the videos at hand alone. Rows are dealt by video and range of frames, so a video is a few files, and a long one several tasks' work."""
    dealt = rows.repartition(video, *more, *([F.floor(F.col(order) / FRAMES)] if order else []))
    ordered = dealt.sortWithinPartitions(video, *more, *([order] if order else []))
    return ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS).partitionBy(video, *more)


def write_detections(detections: DataFrame, path: str, video: str = "video_id") -> None:
    """A folder a video. Videos that are there already are replaced, others stay."""
    _by_video(detections, video, "frame_index").parquet(path)


def write_transforms(maps: DataFrame, path: str, video: str = "video_id") -> None:
    """frame_index, map of each video, a folder a video, as write_detections()."""
    _by_video(maps, video, "frame_index").parquet(path)


def detections_to(path: str, video: str = "video_id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a stream of detections: each batch is a folder of its videos' folders, written anew if the batch is replayed, and named in the list of batches once it is whole.

    What a batch that failed has left behind isn't listed, so read_batches() doesn't see it; its replay replaces it.
    """

    def write(rows: DataFrame, batch: int) -> None:
        kept = rows.withColumn("batch", F.lit(batch).cast("long"))
        kept.sparkSession.range(0).select(F.lit(0).alias("batch")).write.mode("append").parquet(f"{path}/_batches")
        if batch in _whole(rows.sparkSession, path):
            return
        dealt = kept.repartition(video, F.floor(F.col("frame_index") / FRAMES)).sortWithinPartitions(video, "frame_index")
        dealt.drop("batch").write.mode("overwrite").option("maxRecordsPerFile", ROWS).partitionBy(video).parquet(f"{path}/batch={batch}")
        kept.sparkSession.range(1).select(F.lit(batch).cast("int").alias("batch")).coalesce(1).write.mode("append").parquet(f"{path}/_batches")

    return write


def _whole(spark: SparkSession, path: str) -> set[int]:
    """Numbers of batches that are written: as many as a stream has had."""
    return {r.batch for r in spark.read.parquet(f"{path}/_batches").distinct().collect()}


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """What detections_to() has written, of whole batches alone."""
    folders = [f"{path}/batch={b}" for b in sorted(_whole(spark, path))]
    return spark.read.option("basePath", path).parquet(*folders)


def write_node_maps(paths: DataFrame, path: str) -> None:
    """node, depth, shift and map of each video to the main one."""
    paths.write.mode("overwrite").parquet(path)


def write_match_tables(tables: dict[str, DataFrame], path: str, main: str, sub: str) -> None:
    """A CSV folder for each table, named by its kind and the two videos."""
    for kind, table in tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{path}/{kind}{main}_{sub}")


def write_detection_lines(lines: DataFrame, path: str, image: str) -> None:
    """Lines of text, a folder an image; other images stay."""
    _by_video(lines.select(image, F.col("line").alias("value")), image, None).text(path)


def renumbered(rows: DataFrame, key: str, into: str = "id") -> DataFrame:
    """rows with `into`, from 0 without gaps in the order of key.

    Keys are dealt by range and counted in each, so that no task holds all of them.
    """
    keys = rows.select(key).distinct()
    parts = max(1, keys.count() // 1_000_000)
    ranged = written(keys.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()), "keys")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(counts.withColumn("_before", before), "_part")
    placed = placed.withColumn(into, F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1)
    return rows.join(placed.select(key, into), key)


def write_connected(trajectories: DataFrame, path: str, key: str = "id") -> None:
    """Connected trajectories with ids from 0 to n - 1, in order of id and frame."""
    out = renumbered(trajectories.withColumnRenamed(key, "_key"), "_key", key).drop("_key")
    out.repartition(key).sortWithinPartitions(key, "frame_index").write.mode("overwrite").parquet(path)
