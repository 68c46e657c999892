"""Queries on maps from pairs with outliers."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import affine, geometry as G
from lanewise.operators import consensus as C
from lanewise.plans import views as V


def _rounded(fits: DataFrame, *by: str) -> DataFrame:
    return fits.select(*by, *[F.round(c + 3.3e-9, 5).alias(n) for n, c in zip(("a", "b", "tx", "c", "d", "ty"), affine.parts(F.col("map")), strict=True)], *[c for c in ("inliers", "split_x") if c in fits.columns])


def point_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, key, x, y, u, v: places of each supplier's line items on two planes, two of five of them wrong."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    s, wrong = F.col("l_suppkey"), k % 5 < 2
    x, y = F.col("l_partkey") % 640 * 1.0, F.col("l_quantity") * 8 + F.col("l_linenumber")
    u = x * 0.8 - y * 0.6 + 100 + s % 13 + F.when(wrong, 40.0 + k % 97).otherwise(0.0)
    v = x * 0.6 + y * 0.8 - 50 + s % 7 - F.when(wrong, 15.0 + k % 89).otherwise(0.0)
    return V.table(spark, sf_dir, "lineitem").select(s.alias("video_id"), k.alias("key"), x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"))


def consensus_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map between two planes of each supplier, and how many pairs agree with it."""
    return _rounded(C.robust_fits(point_pairs(spark, sf_dir), ["video_id"], "key"), "video_id")


def _shapes(spark: SparkSession, sf_dir: str, main: bool) -> DataFrame:
    """scene, shape_no, label, points: a part is a scene with calibration points in both planes; every third has three, others nine, of which two or three are wrong in main's."""
    k = F.col("p_partkey")

    def place(i):
        x, y = 37.0 * i + k % 11, (i * i) % 7 * 50.0 + k % 17
        if not main:
            return G.point(x, y)
        off = F.when((k % 3 != 0) & ((i + k) % 4 == 1), 60.0 + i * 7).otherwise(0.0)
        return G.point(0.96 * x - 0.28 * y + 7 + off, 0.28 * x + 0.96 * y - 3 - off / 2)

    points = F.transform(F.sequence(F.lit(0), F.when(k % 3 == 0, 2).otherwise(8)), lambda i: place(i))
    return V.table(spark, sf_dir, "part").select(k.alias("scene"), F.lit(0).alias("shape_no"), F.lit("stitch_1").alias("label"), points.alias("points"))


def calibrated_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map from each scene's second plane to its first, and where the first ends."""
    fits = C.calibrated_maps(_shapes(spark, sf_dir, True), _shapes(spark, sf_dir, False), ["scene"], "stitch_")
    return _rounded(fits.withColumn("split_x", F.round("split_x", 5)), "scene")


def fits_sql(pairs: str, by: str, key: str) -> str:
    """CTEs behind `pairs` (by, key, x, y, u, v) up to fits(by, a, b, tx, c, d, ty, inliers)."""

    def error(m: str) -> str:
        return f"({m}.a * x + {m}.b * y + {m}.tx - u) ** 2 + ({m}.c * x + {m}.d * y + {m}.ty - v) ** 2 <= 9.0"

    def refit(name: str, before: str) -> str:
        return f"""
{name}_s AS (SELECT {by}, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, sum(x * x + y * y) AS xx, sum(x * u + y * v) AS xu, sum(x * v - y * u) AS xv
            FROM {pairs} JOIN {before} m USING ({by}) WHERE {error("m")} GROUP BY {by}),
{name}_c AS (SELECT *, (xu - n * (mx * mu + my * mv)) / (xx - n * (mx * mx + my * my)) AS co, (xv - n * (mx * mv - my * mu)) / (xx - n * (mx * mx + my * my)) AS si FROM {name}_s),
{name} AS (SELECT {by}, co AS a, -si AS b, mu - co * mx + si * my AS tx, si AS c, co AS d, mv - si * mx - co * my AS ty, n AS inliers FROM {name}_c)"""

    return f"""
few AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ({key} * {C.FACTOR} + {C.SHIFT}) % {C.PRIME}, {key}, x, y, u, v) AS n FROM {pairs} QUALIFY n <= {C.SAMPLE}),
two AS (SELECT p.{by}, p.n AS i, q.n AS j, p.x, p.y, p.u, p.v, q.x - p.x AS dx, q.y - p.y AS dy, q.u - p.u AS du, q.v - p.v AS dv FROM few p JOIN few q ON p.{by} = q.{by} AND p.n < q.n),
turn AS (SELECT *, (dx * du + dy * dv) / (dx * dx + dy * dy) AS co, (dx * dv - dy * du) / (dx * dx + dy * dy) AS si FROM two WHERE dx * dx + dy * dy <> 0),
hyp AS (SELECT {by}, i, j, co AS a, -si AS b, u - co * x + si * y AS tx, si AS c, co AS d, v - si * x - co * y AS ty FROM turn),
votes AS (SELECT {by}, i, j, count(*) AS n FROM {pairs} JOIN hyp h USING ({by}) WHERE {error("h")} GROUP BY {by}, i, j),
best AS (SELECT hyp.* FROM hyp JOIN (SELECT {by}, i, j FROM votes QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY n DESC, i, j) = 1) USING ({by}, i, j)),
{refit("once", "best")},{refit("fits", "once")}"""


def _rounded_sql(m: str = "") -> str:
    return ", ".join(f"round({m}{c} + 3.3e-9, 5) AS {c}" for c in ("a", "b", "tx", "c", "d", "ty"))


POINT_PAIRS = """pairs AS (
  SELECT l_suppkey AS video_id, k AS key, x, y, x * 0.8 - y * 0.6 + 100 + l_suppkey % 13 + CASE WHEN k % 5 < 2 THEN 40.0 + k % 97 ELSE 0 END AS u,
         x * 0.6 + y * 0.8 - 50 + l_suppkey % 7 - CASE WHEN k % 5 < 2 THEN 15.0 + k % 89 ELSE 0 END AS v
  FROM (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS k, (l_partkey % 640)::DOUBLE AS x, (l_quantity * 8 + l_linenumber)::DOUBLE AS y FROM lineitem))"""

SCENES = """places AS (
  SELECT p_partkey AS scene, i AS key, p_partkey % 3 = 0 AS three, 37.0::DOUBLE * i + p_partkey % 11 AS x, (i * i) % 7 * 50.0::DOUBLE + p_partkey % 17 AS y,
         CASE WHEN p_partkey % 3 <> 0 AND (i + p_partkey) % 4 = 1 THEN 60.0::DOUBLE + i * 7 ELSE 0 END AS off
  FROM part, (SELECT unnest(range(9)) AS i) WHERE i < 3 OR p_partkey % 3 <> 0),
all_pairs AS (SELECT *, 0.96::DOUBLE * x - 0.28::DOUBLE * y + 7 + off AS u, 0.28::DOUBLE * x + 0.96::DOUBLE * y - 3 - off / 2 AS v FROM places),
pairs AS (SELECT * FROM all_pairs WHERE NOT three)"""

QUERIES = {
    "consensus_fits": (consensus_fits, f"WITH {POINT_PAIRS}, {fits_sql('pairs', 'video_id', 'key')} SELECT video_id, {_rounded_sql()}, inliers FROM fits"),
    "calibrated_maps": (
        calibrated_maps,
        f"""WITH {SCENES}, {fits_sql("pairs", "scene", "key")},
ends AS (SELECT scene, round(max(u), 5) AS split_x FROM all_pairs GROUP BY scene),
t AS (SELECT scene, {", ".join(f"max(CASE WHEN key = {i} THEN {c} END) AS {c}{i}" for i in range(3) for c in "xyuv")} FROM all_pairs WHERE three GROUP BY scene),
dets AS (SELECT *, x0 * (y1 - y2) + x1 * (y2 - y0) + x2 * (y0 - y1) AS det FROM t),
exact AS (SELECT scene, {", ".join(f"({w}0 * (y1 - y2) + {w}1 * (y2 - y0) + {w}2 * (y0 - y1)) / det AS {a}, (x0 * ({w}1 - {w}2) + x1 * ({w}2 - {w}0) + x2 * ({w}0 - {w}1)) / det AS {b}, (x0 * (y1 * {w}2 - y2 * {w}1) + x1 * (y2 * {w}0 - y0 * {w}2) + x2 * (y0 * {w}1 - y1 * {w}0)) / det AS {e}" for w, a, b, e in (("u", "a", "b", "tx"), ("v", "c", "d", "ty")))} FROM dets WHERE det <> 0)
SELECT scene, {_rounded_sql("f.")}, split_x FROM (SELECT scene, a, b, tx, c, d, ty FROM fits UNION ALL SELECT * FROM exact) f JOIN ends USING (scene)""",
    ),
}
