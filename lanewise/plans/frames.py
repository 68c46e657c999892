"""Queries on frames: read from files by the frame source, and two videos in lock-step."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators import pairing
from lanewise.plans import views as V
from lanewise.sources import frames as S
from lanewise.tables import shared_folder


def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, part_no, frame_index, width, height, channels, pixels: twenty parts a frame, three frames a file, three videos; missing pixels are black."""
    k = F.col("p_partkey")
    cells = V.table(spark, sf_dir, "part").select(F.floor(k / 20).alias("img"), (k % 20).cast("int").alias("at"), F.col("p_size").alias("v"))
    held = cells.groupBy("img").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    pixel = lambda i: F.lpad(F.hex(F.coalesce(F.element_at("m", i), F.lit(0))), 2, "0")
    pixels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), pixel), ""))
    n = F.floor(F.col("img") / 3)
    return held.select((F.col("img") % 3).cast("string").alias("video_id"), (F.floor(n / 3) + 1).cast("int").alias("part_no"), n.alias("frame_index"), F.lit(5).alias("width"), F.lit(4).alias("height"), F.lit(1).alias("channels"), pixels.alias("pixels"))


def brightness(frames: DataFrame) -> DataFrame:
    """video_id, part_no, frame_index, light (sum of pixels), lit (pixels that aren't black)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = [np.frombuffer(p, np.uint8) for p in batch.column(3).to_pylist()]
            sums = [pa.array([int(p.sum(dtype=np.int64)) for p in pixels], pa.int64()), pa.array([int(np.count_nonzero(p)) for p in pixels], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], *sums], ["video_id", "part_no", "frame_index", "light", "lit"])

    return frames.select("video_id", "part_no", "frame_index", "pixels").mapInArrow(measure, "video_id string, part_no int, frame_index long, light long, lit long")


def frames_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light of every frame of the videos' files but each one's first and last."""
    folder = f"{shared_folder(spark)}/lanewise-frames-{uuid.uuid4().hex}"
    S.write_frames(image_rows(spark, sf_dir), folder)
    return brightness(spark.read.format(S.NAME).option("head", 1).option("tail", 1).load(folder))


def clocked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """pair, frame_index, unix_ms of even users as main and odd ones as sub videos; sub videos keep two frames of three, so rates and gaps differ."""
    e = V.table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 2).alias("pair"), "user_id", F.col("event_id").alias("frame_index"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("unix_ms"))
    main = e.filter("user_id % 2 = 0")
    return main.drop("user_id"), e.filter("user_id % 2 = 1 and frame_index % 3 <> 1").drop("user_id")


def paired_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two videos in lock-step from the point at which their clocks meet."""
    main, sub = clocked(spark, sf_dir)
    return pairing.lock_step(main, sub, ["pair"], tolerance=3_600_000.0)


QUERIES = {
    "frames_by_source": (
        frames_by_source,
        """WITH f AS (SELECT (p_partkey // 20) % 3 AS video, p_partkey // 20 // 3 AS n, sum(p_size) AS light, count(*) FILTER (p_size <> 0) AS lit FROM part GROUP BY 1, 2)
SELECT video::VARCHAR AS video_id, (n // 3 + 1)::INTEGER AS part_no, n::BIGINT AS frame_index, light::BIGINT AS light, lit::BIGINT AS lit FROM f
QUALIFY n >= 1 AND n < max(n) OVER (PARTITION BY video)""",
    ),
    "paired_frames": (
        paired_frames,
        """WITH e AS (SELECT user_id // 2 AS pair, user_id % 2 AS side, event_id AS f, epoch_us(ts) // 1000 AS ms FROM events WHERE user_id % 2 = 0 OR event_id % 3 <> 1),
first AS (SELECT pair, min(ms) FILTER (side = 0) AS m, min(ms) FILTER (side = 1) AS s FROM e GROUP BY pair),
kept AS (SELECT e.*, row_number() OVER (PARTITION BY e.pair, side ORDER BY f) - 2 AS n FROM e JOIN first USING (pair)
         WHERE m IS NOT NULL AND s IS NOT NULL AND ms >= CASE WHEN abs(m - s) <= 3600000 THEN CASE side WHEN 0 THEN m ELSE s END ELSE greatest(m, s) END)
SELECT pair, a.n, a.f AS main_frame_index, a.ms AS main_unix_ms, b.f AS sub_frame_index, b.ms AS sub_unix_ms
FROM (SELECT * FROM kept WHERE side = 0 AND n >= 0) a JOIN (SELECT * FROM kept WHERE side = 1 AND n >= 0) b USING (pair, n)""",
    ),
}
