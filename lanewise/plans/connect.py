"""The whole way from points of many videos and their graph to connected trajectories."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators import connect
from lanewise.plans import views as V
from lanewise.tables import shared_folder

#: Vehicles of a scene; places between scenes; frames that a scene's second and third video are behind the one before.
SCENE, APART, BEHIND = 6, 4096.0, 5


def scenes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """points, edges and clocks: each six vehicles are seen by three videos, the second turned by a quarter against the first, the third by another; scenes hang on one another as a tree."""
    p = V.points(spark, sf_dir).withColumn("scene", F.floor(F.col("veh_id") / SCENE)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    x = F.when(F.col("k") == 0, F.col("x")).when(F.col("k") == 1, F.col("y")).otherwise(-F.col("x"))
    y = F.when(F.col("k") == 0, F.col("y")).when(F.col("k") == 1, -F.col("x")).otherwise(-F.col("y"))
    points = p.select((F.col("scene") * 3 + F.col("k")).alias("video_id"), "veh_id", (F.col("frame_index") - F.col("k") * BEHIND).alias("frame_index"), x.alias("x"), y.alias("y"), "lane_id")
    videos = points.select("video_id").distinct()
    k, scene = F.col("video_id") % 3, F.floor(F.col("video_id") / 3)
    six = lambda *v: F.array(*[F.lit(float(n)) if not hasattr(n, "cast") else n.cast("double") for n in v])
    to = F.when(k > 0, F.col("video_id") - 1).otherwise(F.floor((scene - 1) / 2) * 3)
    own = F.when(k > 0, six(0, -1, 0, 1, 0, 0)).otherwise(six(1, 0, (scene - F.floor((scene - 1) / 2)) * APART, 0, 1, 0))
    edges = videos.filter("video_id > 0").select(F.col("video_id").alias("src"), to.alias("dst"), F.when(k > 0, BEHIND).otherwise(0).alias("shift"), own.alias("map"))
    return points, edges, videos.select("video_id", F.lit(0).alias("first_frame"), F.lit(0.0).alias("start_ms"), F.lit(40.0).alias("delta_ms"))


def connected_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vehicle once, in the plane and frame numbers of the first video."""
    out = connect.connected_trajectories(*scenes(spark, sf_dir), 0, f"{shared_folder(spark)}/lanewise-connect-{uuid.uuid4().hex}")
    return out.select("id", "frame_index", F.round(F.col("x") + 3.3e-9, 4).alias("x"), F.round(F.col("y") + 3.3e-9, 4).alias("y"), "is_fused")


# Views of a vehicle match where it is there for more than four frames; the third view only where its first frame isn't before the second video's horizon. What doesn't match stays a trajectory of its own.
SQL = f"""WITH {V.POINTS},
v AS (SELECT veh_id, veh_id // {SCENE} AS scene, min(frame_index) AS f0, max(frame_index) - min(frame_index) AS span FROM points GROUP BY 1),
n AS (SELECT veh_id, scene, k, (scene * 3 + k)::VARCHAR || '|' || veh_id AS node, CASE WHEN span < 5 THEN k WHEN f0 < {BEHIND} AND k = 2 THEN 2 ELSE 0 END AS part FROM v, range(0, 3) AS r(k)),
c AS (SELECT *, min(node) OVER (PARTITION BY veh_id, part) AS name, count(*) OVER (PARTITION BY veh_id, part) > 1 AS is_fused FROM n),
i AS (SELECT DISTINCT veh_id, scene, name, is_fused FROM c)
SELECT d.id, frame_index, round(x + {APART} * scene + 3.3e-9, 4) AS x, round(y + 3.3e-9, 4) AS y, is_fused
FROM (SELECT *, dense_rank() OVER (ORDER BY name) - 1 AS id FROM i) d JOIN points USING (veh_id)"""

QUERIES = {"connected_videos": (connected_videos, SQL)}
