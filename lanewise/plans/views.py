"""Views of the star-schema tables as points, boxes, tracks and graphs, each for Spark and as SQL of the same meaning."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_of_2024(ts: str = "ts"):
    """Without a time zone: days since New Year times 24, and the hour."""
    return (F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")) * 24 + F.hour(ts)).cast("long")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """veh_id, frame_index, x, y, lane_id: a vehicle's mean place in each hour."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("veh_id"), hour_of_2024().alias("frame_index"), "value", k.alias("k"))
    places = (F.round(F.avg("value"), 6).alias("x"), F.round(F.avg("k"), 6).alias("y"), (F.max("k") % 4).alias("lane_id"))
    return rows.groupBy("veh_id", "frame_index").agg(*places)


POINTS = """points AS (
  SELECT user_id AS veh_id, (date_diff('day', DATE '2024-01-01', ts::DATE) * 24 + hour(ts))::BIGINT AS frame_index,
         round(avg(value), 6) AS x, round(avg((props->>'$.k')::INTEGER), 6) AS y, (max((props->>'$.k')::INTEGER) % 4)::INTEGER AS lane_id
  FROM events GROUP BY 1, 2)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_index, det_id, cx, cy, w, h, score, category and l, t, r, b: upright boxes of a frame."""
    rows = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    out = rows.select(
        F.col("l_orderkey").alias("frame_index"),
        F.row_number().over(order).alias("det_id"),
        (F.col("l_partkey") % 61 * 3).cast("double").alias("cx"),
        (F.col("l_suppkey") % 37 * 3).cast("double").alias("cy"),
        (24 + F.col("l_quantity") / 5).alias("w"),
        (10 + F.col("l_quantity") / 10).alias("h"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_linenumber") % 5).alias("category"),
    )
    half = {"l": F.col("cx") - F.col("w") / 2, "t": F.col("cy") - F.col("h") / 2, "r": F.col("cx") + F.col("w") / 2, "b": F.col("cy") + F.col("h") / 2}
    return out.withColumns(half)


BOXES = """boxes AS (
  SELECT *, cx - w / 2 AS l, cy - h / 2 AS t, cx + w / 2 AS r, cy + h / 2 AS b FROM (
    SELECT l_orderkey AS frame_index,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::INTEGER AS det_id,
           (l_partkey % 61 * 3)::DOUBLE AS cx, (l_suppkey % 37 * 3)::DOUBLE AS cy, 24 + l_quantity / 5 AS w, 10 + l_quantity / 10 AS h,
           l_extendedprice AS score, (l_linenumber % 5)::INTEGER AS category
    FROM lineitem))"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: a tree of videos whose root is 0."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").filter("n_nationkey > 0").select(n.alias("src"), F.floor((n - 1) / 2).cast("int").alias("dst"))


GRAPH = "graph AS (SELECT n_nationkey AS src, ((n_nationkey - 1) // 2)::INTEGER AS dst FROM nation WHERE n_nationkey > 0)"


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, y, x, v: parts laid out as grids of 20 columns by 10 rows."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((k / 200).cast("int").alias("img_id"), ((k % 200) / 20).cast("int").alias("y"), (k % 20).cast("int").alias("x"), F.col("p_size").alias("v"), k.alias("cell"))


HEAT = "heat AS (SELECT (p_partkey // 200)::INTEGER AS img_id, ((p_partkey % 200) // 20)::INTEGER AS y, (p_partkey % 20)::INTEGER AS x, p_size AS v, p_partkey AS cell FROM part)"

#: An annotated road: four lanes side by side over the places of points(); the frame of reference; a driving line.
LANES = [(n, [(5.0, 12.5 * k + 0.5), (150.0, 12.5 * k + 4.5), (150.0, 12.5 * k + 16.5), (5.0, 12.5 * k + 12.5)]) for k, n in enumerate((1, 2, 3, 4, 5, 6))]
AXIS = {"origin": (10.0, 20.0), "x_axis": (110.0, 45.0), "y_axis": (0.0, 80.0), "per_pixel": 0.125}
LINE = [(0.0, 10.0), (20.0, 30.0), (60.0, 35.0), (120.0, 90.0)]


def lanes_sql() -> str:
    """edges(lane, ord, x1, y1, x2, y2) of LANES."""
    rows = [(n, i, *ring[j], *ring[(j + 1) % len(ring)]) for i, (n, ring) in enumerate(LANES) for j in range(len(ring))]
    values = ", ".join("(" + ", ".join(f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
    return f"edges AS (SELECT * FROM (VALUES {values}) AS e(lane, ord, x1, y1, x2, y2))"


INSIDE = """hits AS (
  SELECT veh_id, frame_index, ord, lane FROM points, edges GROUP BY veh_id, frame_index, ord, lane
  HAVING sum(CASE WHEN ((y1 < y AND y <= y2) OR (y2 < y AND y <= y1)) AND x1 + (y - y1) / nullif(y2 - y1, 0) * (x2 - x1) < x THEN 1 ELSE 0 END) % 2 = 1
     AND NOT bool_or((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2))),
placed AS (
  SELECT p.*, coalesce(h.lane, -1) AS lane FROM points p
  LEFT JOIN (SELECT veh_id, frame_index, min_by(lane, ord) AS lane FROM hits GROUP BY 1, 2) h USING (veh_id, frame_index))"""
