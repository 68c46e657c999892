"""Detector outputs as boxes, and forms of boxes, as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import geometry as G


def logistic(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def centre_head(x: Column, y: Column, wh: list[Column], turned: Column, scale_x: Column, scale_y: Column, least: float = 0.8) -> dict[str, Column]:
    """Corners of a box from a centre and ten numbers: vectors to its top, right, bottom and left, then width and height.

    Where `turned` is over `least` the vectors hold, else the box is upright. Corners in the order top right, bottom right, bottom left, top left, times the scales.
    """
    w, h = wh[8], wh[9]
    upright = ((F.lit(0.0), -h / 2), (w / 2, F.lit(0.0)), (F.lit(0.0), h / 2), (-w / 2, F.lit(0.0)))
    pick = lambda i: tuple(F.when(turned > least, wh[2 * i + j]).otherwise(upright[i][j]) for j in (0, 1))
    top, right, bottom, left = (pick(i) for i in range(4))
    out = {"cx": x * scale_x, "cy": y * scale_y}
    for k, (p, q) in enumerate(((top, right), (bottom, right), (bottom, left), (top, left)), 1):
        out |= {f"x{k}": (x + p[0] + q[0]) * scale_x, f"y{k}": (y + p[1] + q[1]) * scale_y}
    return out


def grid_head(cell_x: Column, cell_y: Column, stride: Column, values: list[Column]) -> dict[str, Column]:
    """Centre, size and score of a grid cell's output: offsets, logarithms of the size, and the logits of object and class."""
    dx, dy, log_w, log_h, thing, kind = values
    return {"cx": (cell_x + dx) * stride, "cy": (cell_y + dy) * stride, "w": F.exp(log_w) * stride, "h": F.exp(log_h) * stride, "score": logistic(thing) * logistic(kind)}


def letterbox(width: Column, height: Column, to_width: int, to_height: int) -> dict[str, Column]:
    """scale, pad_x, pad_y that fit an image into a frame, centred."""
    scale = F.least(F.lit(float(to_width)) / width, F.lit(float(to_height)) / height)
    pad = lambda side, to: F.floor((to - (side * scale).cast("int")) / 2).cast("int")
    return {"scale": scale, "pad_x": pad(width, to_width), "pad_y": pad(height, to_height)}


def from_letterbox(x: Column, y: Column, scale: Column, pad_x: Column, pad_y: Column) -> tuple[Column, Column]:
    return (x - pad_x) / scale, (y - pad_y) / scale


def normalised(v: Column, mean: float = 0.5, std: float = 1.0) -> Column:
    """A pixel's value from 0 to 255 in units of 255, less the mean, by the deviation."""
    return (v / 255.0 - mean) / std


def corner_mean(c: list[Column]) -> tuple[Column, Column]:
    """Mean place of corners x1, y1 .. x4, y4."""
    return sum(c[2::2], c[0]) / 4, sum(c[3::2], c[1]) / 4


def upright_if_full(c: list[Column], least: float = 0.9) -> list[Column]:
    """The corners, or those of their bounds where the figure fills more than `least` of them."""
    l, t, r, b = G.bounds(c)
    ring = F.array(*[G.point(c[i], c[i + 1]) for i in range(0, 8, 2)])
    full = G.polygon_area(ring) / F.nullif((r - l) * (b - t), F.lit(0.0)) > least
    return [F.when(full, v).otherwise(o) for v, o in zip((r, t, r, b, l, b, l, t), c, strict=True)]


def least_rectangle(c: list[Column]) -> Column:
    """rectangle_around() a convex figure of four corners."""
    return rectangle_around(F.array(*[G.point(c[i], c[i + 1]) for i in range(0, 8, 2)]))


def least_rectangle_of(points: Column) -> Column:
    """rectangle_around() any array of points: of one point, or one many times, it has no sides; null for none."""
    alone = F.get(points, F.lit(0))
    no_sides = F.struct(alone.x.cast("double").alias("cx"), alone.y.cast("double").alias("cy"), *[F.lit(0.0).alias(n) for n in ("w", "h", "theta")])
    return F.coalesce(rectangle_around(G.convex_hull(points)), F.when(alone.isNotNull(), no_sides))


def rectangle_around(ring: Column) -> Column:
    """struct(cx, cy, w, h, theta) of the rectangle of least area around a convex figure.

    One side of it lies on a side of the figure, so as many candidates are compared. w runs along theta, which is in [-pi/2, pi/2).
    """

    def around(ring: Column, i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % F.greatest(F.size(ring), F.lit(1)))
        n = F.nullif(F.hypot(q.x - p.x, q.y - p.y), F.lit(0.0))

        def box(u: Column) -> Column:
            """u: direction of the side. The figure's reach along it and across it."""
            reach = lambda f: F.transform(ring, f)
            along, across = reach(lambda c: c.x * u.x + c.y * u.y), reach(lambda c: c.y * u.x - c.x * u.y)
            ends = F.struct(F.array_min(along).alias("l"), F.array_max(along).alias("r"), F.array_min(across).alias("t"), F.array_max(across).alias("b"))

            def made(e: Column) -> Column:
                x, y, w, h = (e.l + e.r) / 2, (e.t + e.b) / 2, e.r - e.l, e.b - e.t
                form = {"cx": x * u.x - y * u.y, "cy": x * u.y + y * u.x, "w": w, "h": h, "theta": G.wrap_half_turn(F.atan2(u.y, u.x))}
                return F.struct(F.round(w * h, 9).alias("area"), i.alias("i"), F.struct(*[v.alias(k) for k, v in form.items()]).alias("box"))

            return G.let(ends, made)

        return F.when(n.isNotNull(), G.let(F.struct(((q.x - p.x) / n).alias("x"), ((q.y - p.y) / n).alias("y")), box))

    sides = lambda r: F.sequence(F.lit(0), F.greatest(F.size(r) - 1, F.lit(0)))
    return G.let(ring, lambda r: F.array_min(F.array_compact(F.transform(sides(r), lambda i: around(r, i))))).box


def turned_detections(boxes: DataFrame, least: float) -> DataFrame:
    """boxes (cx, cy, w, h, theta, score) over the score, with `corners`, eight numbers."""
    return boxes.filter(F.col("score") > least).withColumn("corners", F.array(*G.corners(*[F.col(n) for n in ("cx", "cy", "w", "h", "theta")])))


def label(parts: dict[str, tuple[str, Column]]) -> Column:
    """`name:value` of each part, by its format, parted by spaces; parts that are null are left out."""
    return F.concat_ws(" ", *[F.when(value.isNotNull(), F.concat(F.lit(f"{name}:"), F.format_string(form, value))) for name, (form, value) in parts.items()])


def running_mean(value: str, by: list[str], order: str) -> Column:
    """Mean of a key's values up to and with each row."""
    from pyspark.sql import Window

    return F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
