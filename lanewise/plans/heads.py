"""Queries on output tensors: each image of heat() gives levels of made channels."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators import head_tensors as H
from lanewise.plans import views as V

#: Width and height of the network's input, and of the images.
INPUT, IMAGE = (640, 320), (1200, 500)
LEVELS = ((0, 20, 10, 1), (1, 10, 5, 2))


def channel(index: Column, value: Column) -> Column:
    """A made output of a channel, in eighths, so that 32 bits hold it exactly."""
    return (F.pmod(value * (index + 1), F.lit(13)) - 6) / 8.0


def levels(spark: SparkSession, sf_dir: str, channels: int, every: tuple = LEVELS) -> DataFrame:
    """image_id, level, height, width, data: a grid of all pixels and one of every second, pixels that aren't there as zero."""
    held = V.heat(spark, sf_dir).groupBy(F.col("img_id").alias("image_id")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * 20 + F.col("x")).alias("at"), "v"))).alias("m"))
    out = None
    for level, width, height, step in every:
        cells = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda c: F.coalesce(F.element_at("m", (F.floor(c / width) * step * 20 + c % width * step).cast("int")), F.lit(0)))  # noqa: B023
        values = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda i: F.transform(F.col("cells"), lambda v: channel(i, v))))
        rows = held.select("image_id", F.lit(level).alias("level"), F.lit(height).alias("height"), F.lit(width).alias("width"), cells.alias("cells")).withColumn("values", values)
        out = rows if out is None else out.unionByName(rows)
    return H.folded(out, ["image_id", "level", "height", "width"])


def _grid(spark: SparkSession, sf_dir: str, channels: int, vectors_at: int) -> DataFrame:
    found = H.grid_detections(levels(spark, sf_dir, channels), INPUT[1], vectors_at, 0.3)
    images = V.heat(spark, sf_dir).select(F.col("img_id").alias("image_id")).distinct().withColumns({"width": F.lit(IMAGE[0]), "height": F.lit(IMAGE[1])})
    out = H.in_image(found, images, *INPUT)
    return out.select("image_id", "level", "cell", "category", *[F.round(F.col(c) + 3.3e-9, 4).alias(c) for c in ("cx", "cy", "w", "h", "x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4", "score")])


def head_of_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from tensors of 21 channels, vectors from the seventh on."""
    return _grid(spark, sf_dir, 21, 6)


def head_of_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from tensors of 19 channels, vectors from the fifth on."""
    return _grid(spark, sf_dir, 19, 4)


def centre_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes at the twenty strongest peaks of each image."""
    out = H.centre_detections(levels(spark, sf_dir, 2, LEVELS[:1]), levels(spark, sf_dir, 13, LEVELS[:1]), 20, -0.5)
    return out.select("image_id", "cell", "category", *[F.round(F.col(c) + 3.3e-9, 4).alias(c) for c in ("score", "cx", "cy", "x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4")])


CELLS = f"""{V.HEAT}, spots AS (SELECT img_id, l, c, c % w AS x, c // w AS y, w, step FROM (SELECT DISTINCT img_id FROM heat), (VALUES (0, 20, 200, 1), (1, 10, 50, 2)) AS g(l, w, n, step), range(0, 200) AS r(c) WHERE c < n),
cells AS (SELECT s.img_id AS image_id, l AS level, c AS cell, s.x, s.y, coalesce(h.v, 0) AS v FROM spots s LEFT JOIN heat h ON h.img_id = s.img_id AND h.x = s.x * step AND h.y = s.y * step)"""


def _channel(i: int) -> str:
    return f"((v * {i + 1} % 13 - 6) / 8.0::DOUBLE)"


def _grid_sql(channels: int, at: int) -> str:
    sigmoid = lambda c: f"(1 / (1 + exp(-{c})))"
    kinds = ", ".join(sigmoid(_channel(i)) for i in range(at + 10, channels))
    corners = ((0, 3, "-", "-"), (0, 1, "+", "-"), (2, 1, "+", "+"), (2, 3, "-", "+"))
    names = ", ".join(f"CASE WHEN turned < 0.8 THEN c{a} {(sx, sy)[j]} {('w', 'h')[j]} / 2 ELSE c{a} + {_channel(at + 2 * p + j)} * s + {_channel(at + 2 * q + j)} * s END AS {a}{k}" for k, (p, q, sx, sy) in enumerate(corners, 1) for j, a in enumerate("xy"))
    new = (round(IMAGE[0] * min(INPUT[0] / IMAGE[0], INPUT[1] / IMAGE[1])), round(IMAGE[1] * min(INPUT[0] / IMAGE[0], INPUT[1] / IMAGE[1])))
    own = lambda a: f"({a} - {(INPUT['xy'.index(a[-1] if a[0] == 'c' else a[0])] - new['xy'.index(a[-1] if a[0] == 'c' else a[0])]) / 2}::DOUBLE) * {IMAGE['xy'.index(a[-1] if a[0] == 'c' else a[0])]} / {new['xy'.index(a[-1] if a[0] == 'c' else a[0])]}"
    shown = ", ".join(f"round({own(a)} + 3.3e-9, 4) AS {a}" for a in ("cx", "cy", *[f"{a}{k}" for k in range(1, 5) for a in "xy"]))
    return f"""WITH {CELLS},
d AS (SELECT *, CASE level WHEN 0 THEN 32.0::DOUBLE ELSE 64.0 END AS s, {sigmoid(_channel(at + 8))} AS turned, {sigmoid(_channel(at + 9))} AS thing, [{kinds}] AS kinds FROM cells),
e AS (SELECT *, thing * list_max(kinds) AS score, ({_channel(0)} + x) * s AS cx, ({_channel(1)} + y) * s AS cy, exp({_channel(2)}) * s AS w, exp({_channel(3)}) * s AS h FROM d),
f AS (SELECT *, list_position(kinds, list_max(kinds))::INTEGER - 1 AS category, {names} FROM e WHERE score >= 0.3)
SELECT image_id, level::INTEGER AS level, cell::INTEGER AS cell, category, {shown}, round(w * {IMAGE[0]} / {new[0]} + 3.3e-9, 4) AS w, round(h * {IMAGE[1]} / {new[1]} + 3.3e-9, 4) AS h, round(score + 3.3e-9, 4) AS score FROM f"""


def _centre_sql() -> str:
    upright = (("0", f"- {_channel(9)} / 2"), (f"{_channel(8)} / 2", "0"), ("0", f"{_channel(9)} / 2"), (f"- {_channel(8)} / 2", "0"))
    pick = lambda i, j: f"CASE WHEN {_channel(12)} > 0.8 THEN {_channel(2 * i + j)} ELSE {upright[i][j]} END"
    places = ", ".join(f"round((c{a} + {pick(p, j)} + {pick(q, j)}) * 4 + 3.3e-9, 4) AS {a}{k}" for k, (p, q) in enumerate(((0, 1), (2, 1), (2, 3), (0, 3)), 1) for j, a in enumerate("xy"))
    return f"""WITH {CELLS},
hm AS (SELECT image_id, cell, x, y, v, k AS category, (v * (k + 1) % 13 - 6) / 8.0::DOUBLE AS score FROM cells, range(0, 2) AS r(k) WHERE level = 0),
tops AS (SELECT a.* FROM hm a JOIN hm b ON a.image_id = b.image_id AND a.category = b.category AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL HAVING a.score = max(b.score) AND a.score > -0.5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, category ORDER BY score DESC, category, cell) AS n FROM tops),
best AS (SELECT *, x + {_channel(10)} AS cx, y + {_channel(11)} AS cy FROM ranked WHERE n <= 20 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, category, cell) <= 20)
SELECT image_id, cell::INTEGER AS cell, category::INTEGER AS category, round(score + 3.3e-9, 4) AS score, {places}, round(cx * 4 + 3.3e-9, 4) AS cx, round(cy * 4 + 3.3e-9, 4) AS cy FROM best"""


QUERIES = {"head_of_21": (head_of_21, _grid_sql(21, 6)), "head_of_19": (head_of_19, _grid_sql(19, 4)), "centre_tensors": (centre_tensors, _centre_sql())}
