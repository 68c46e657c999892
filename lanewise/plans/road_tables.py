"""Queries on roads that are tables: each supplier is a video with lanes, lane lines and driving lines of its own; its line items are the points."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import geometry as G
from lanewise.operators import road_tables as R
from lanewise.plans import views as V

#: Cells of the cover, in pixels.
CELL = 8.0


def video_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame_index, no, x, y: the line items of a supplier, as places on its road."""
    x = F.col("l_partkey") % 160 * 1.0 + F.col("l_linenumber") / 8
    y = F.col("l_quantity") * 2.0 + F.col("l_orderkey") % 8 / 4.0
    return V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("video_id"), F.col("l_orderkey").alias("frame_index"), F.col("l_linenumber").alias("no"), x.alias("x"), y.alias("y"))


VIDEO_POINTS = """vp AS (
  SELECT row_number() OVER () AS r, l_suppkey AS video_id, l_orderkey AS frame_index, l_linenumber AS no,
         l_partkey % 160 * 1.0::DOUBLE + l_linenumber / 8.0::DOUBLE AS x, l_quantity * 2.0::DOUBLE + (l_orderkey % 8) / 4.0::DOUBLE AS y FROM lineitem)"""


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, k from 0 to 4, a and b: what a supplier's lanes and lines are shifted by."""
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("video_id"), (F.col("s_suppkey") % 11 * 1.0).alias("a"), (F.col("s_suppkey") % 7 * 1.0).alias("b"))
    return s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))


ROADS = """roads AS (SELECT s_suppkey AS video_id, s_suppkey % 11 * 1.0::DOUBLE AS a, s_suppkey % 7 * 1.0::DOUBLE AS b, k FROM supplier, (SELECT unnest(range(5))::INTEGER AS k))"""


def lane_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, ord, lane, ring, points, base, start, per_pixel: five lanes that overlap a little, in falling order for odd videos; the fourth is a wedge with a notch."""
    k, a, b = F.col("k"), F.col("a"), F.col("b")
    p = lambda x, y: G.point(x, y)
    low = k * 20.0 + b
    plain = F.array(p(a, low), p(a + 140, low + 3), p(a + 140, low + 25), p(a, low + 22))
    notched = F.array(p(a, low), p(a + 140, low + 3), p(a + 70, low + 10), p(a + 140, low + 25), p(a, low + 22))
    line = F.array(p(a, low + 11), p(a + 60, low + 13), p(a + 140, low + 14))
    order = F.when(F.col("video_id") % 2 == 1, 4 - k).otherwise(k)
    return roads(spark, sf_dir).select("video_id", order.alias("ord"), (k + 1).alias("lane"), F.when(k == 3, notched).otherwise(plain).alias("ring"), line.alias("points"), F.lit(10.0).alias("base"), (k * 1000.0).alias("start"), F.lit(0.25).alias("per_pixel"))


LANE_EDGES = """corners AS (
  SELECT video_id, CASE WHEN video_id % 2 = 1 THEN 4 - k ELSE k END AS ord, k + 1 AS lane, k, a, k * 20.0::DOUBLE + b AS low FROM roads),
rings AS (
  SELECT *, CASE WHEN k = 3 THEN [[a, low], [a + 140, low + 3], [a + 70, low + 10], [a + 140, low + 25], [a, low + 22]]
                 ELSE [[a, low], [a + 140, low + 3], [a + 140, low + 25], [a, low + 22]] END AS ring FROM corners),
edges AS (
  SELECT video_id, ord, lane, ring[i][1] AS x1, ring[i][2] AS y1, ring[i % len(ring) + 1][1] AS x2, ring[i % len(ring) + 1][2] AS y2
  FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM rings)),
hits AS (
  SELECT r, ord, lane FROM vp JOIN edges USING (video_id) GROUP BY r, ord, lane
  HAVING sum(CASE WHEN ((y1 < y AND y <= y2) OR (y2 < y AND y <= y1)) AND x1 + (y - y1) / nullif(y2 - y1, 0) * (x2 - x1) < x THEN 1 ELSE 0 END) % 2 = 1
     AND NOT bool_or((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2))),
placed AS (SELECT vp.*, h.lane AS held FROM vp LEFT JOIN (SELECT r, min_by(lane, ord) AS lane FROM hits GROUP BY r) h USING (r))"""


def lanes_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane of every point on the road of its own video."""
    out = R.lanes_from_table(video_points(spark, sf_dir), lane_polygons(spark, sf_dir), size=CELL)
    return out.select("video_id", "frame_index", "no", "x", "y", "lane")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, a, b = F.col("k"), F.col("a"), F.col("b")
    low = k * 20.0 + b
    return roads(spark, sf_dir).filter((F.col("video_id") % 5 != 0) | (k == 0)).select("video_id", (k + F.when(k > 2, 2).otherwise(1)).alias("number"), F.array(G.point(a, low), G.point(a + 80, low + 6), G.point(a + 150, low + 2)).alias("points"))


def lines_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane between the two nearest lane lines of the point's video; one road in five has one line, and numbers leave out 4."""
    out = R.between_lines_from_table(video_points(spark, sf_dir), _lines(spark, sf_dir))
    return out.select("video_id", "frame_index", "no", "lane")


def regions_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres along and beside the driving line of the region that holds a point."""
    out = R.along_lines_from_table(video_points(spark, sf_dir), lane_polygons(spark, sf_dir), size=CELL)
    return out.select("video_id", "frame_index", "no", "lane", F.round("line_pos", 4).alias("line_pos"), F.round("line_offset", 4).alias("line_offset"))


def _nearest_sql(points: str, lines: str, keys: str) -> str:
    """segs(r, keys, dist, pos) of the nearest segment of each line; lines: video_id, keys, x1, y1, x2, y2, n (segment), run (length before it)."""
    return f"""
spots AS (
  SELECT r, {keys}, n, run, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len, x, y, x1, y1, x2, y2,
         greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t
  FROM {points} p JOIN {lines} l USING (video_id)),
segs AS (
  SELECT r, {keys}, min(d) AS dist, min_by(run + t * len, (d, n)) AS pos
  FROM (SELECT *, sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) AS d FROM spots) GROUP BY r, {keys})"""


LINES_SQL = f"""
WITH {VIDEO_POINTS}, {ROADS},
ls AS (SELECT video_id, k + CASE WHEN k > 2 THEN 2 ELSE 1 END AS number, a, k * 20.0::DOUBLE + b AS low FROM roads WHERE video_id % 5 <> 0 OR k = 0),
parts AS (SELECT video_id, number, 0 AS n, 0.0 AS run, a AS x1, low AS y1, a + 80 AS x2, low + 6 AS y2 FROM ls
          UNION ALL SELECT video_id, number, 1, 0.0, a + 80, low + 6, a + 150, low + 2 FROM ls),
{_nearest_sql("vp", "parts", "number")},
near AS (SELECT r, number, row_number() OVER (PARTITION BY r ORDER BY dist, number) AS k FROM segs),
both_ AS (SELECT r, max(CASE WHEN k = 1 THEN number END) AS p, max(CASE WHEN k = 2 THEN number END) AS q FROM near WHERE k <= 2 GROUP BY r)
SELECT video_id, frame_index, no, CASE WHEN abs(p - q) = 1 THEN least(p, q) ELSE -1 END::INTEGER AS lane FROM vp LEFT JOIN both_ USING (r)"""

REGIONS_SQL = f"""
WITH {VIDEO_POINTS}, {ROADS}, {LANE_EDGES},
parts AS (SELECT video_id, lane, 0 AS n, 0.0 AS run, a AS x1, low + 11 AS y1, a + 60 AS x2, low + 13 AS y2 FROM corners
          UNION ALL SELECT video_id, lane, 1, sqrt(60.0 ** 2 + 2.0 ** 2), a + 60, low + 13, a + 140, low + 14 FROM corners),
{_nearest_sql("(SELECT * FROM placed WHERE held IS NOT NULL)", "parts", "lane").replace("USING (video_id))", "USING (video_id) WHERE lane = held)")}
SELECT video_id, frame_index, no, held AS lane, round((pos - 10) * 0.25 + (held - 1) * 1000, 4) AS line_pos, round(dist * 0.25, 4) AS line_offset FROM placed LEFT JOIN segs USING (r)"""

QUERIES = {
    "lanes_by_table": (lanes_by_table, f"WITH {VIDEO_POINTS}, {ROADS}, {LANE_EDGES} SELECT video_id, frame_index, no, x, y, coalesce(held, -1)::INTEGER AS lane FROM placed"),
    "lines_by_table": (lines_by_table, LINES_SQL),
    "regions_by_table": (regions_by_table, REGIONS_SQL),
}
