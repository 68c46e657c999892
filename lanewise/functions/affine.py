"""Affine maps of the plane as arrays of six numbers (a, b, tx, c, d, ty): x' = a x + b y + tx, y' = c x + d y + ty."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAME = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def parts(m: Column) -> list[Column]:
    return [F.get(m, F.lit(i)) for i in range(6)]


def identity() -> Column:
    return F.array(*[F.lit(v) for v in SAME])


def applied(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    a, b, tx, c, d, ty = parts(m)
    return a * x + b * y + tx, c * x + d * y + ty


def composed(outer: Column, inner: Column) -> Column:
    """First inner, then outer."""
    a, b, tx, c, d, ty = parts(outer)
    e, f, ux, g, h, uy = parts(inner)
    return F.array(a * e + b * g, a * f + b * h, a * ux + b * uy + tx, c * e + d * g, c * f + d * h, c * ux + d * uy + ty)


def inverse(m: Column) -> Column:
    """Null where the map flattens the plane."""
    a, b, tx, c, d, ty = parts(m)
    det = F.nullif(a * d - b * c, F.lit(0.0))
    out = F.array(d / det, -b / det, (b * ty - d * tx) / det, -c / det, a / det, (c * tx - a * ty) / det)
    return F.when(det.isNotNull(), out)


def normal(m: Column, keep_scale: bool = True, keep_shift: bool = True) -> Column:
    """The map made of m's turn alone, with m's scale (that of its first column) and shift if they are kept."""
    a, _, tx, c, _, ty = parts(m)
    turn, scale = F.atan2(c, a), F.hypot(a, c) if keep_scale else F.lit(1.0)
    cos, sin = scale * F.cos(turn), scale * F.sin(turn)
    shift = (tx, ty) if keep_shift else (F.lit(0.0), F.lit(0.0))
    return F.array(cos, -sin, shift[0], sin, cos, shift[1])


def similarity_fit(x: Column, y: Column, u: Column, v: Column) -> Column:
    """An aggregate: the turn, scale and shift that bring points (x, y) nearest to points (u, v), by least squares; null for fewer than two different points.

    The sums of the four-number model in closed form, so partial sums merge and any number of points is one row.
    """
    n = F.count(x)
    mx, my, mu, mv = F.avg(x), F.avg(y), F.avg(u), F.avg(v)
    spread = F.nullif(F.sum(x * x + y * y) - n * (mx * mx + my * my), F.lit(0.0))
    cos = (F.sum(x * u + y * v) - n * (mx * mu + my * mv)) / spread
    sin = (F.sum(x * v - y * u) - n * (mx * mv - my * mu)) / spread
    return F.when(n > 1, F.array(cos, -sin, mu - cos * mx + sin * my, sin, cos, mv - sin * mx - cos * my))


def product(p: list[float], e: list[float]) -> list[float]:
    """First e, then p, of numbers."""
    (a, b, tx, c, d, ty), (f, g, ux, h, i, uy) = p, e
    return [a * f + b * h, a * g + b * i, a * ux + b * uy + tx, c * f + d * h, c * g + d * i, c * ux + d * uy + ty]
