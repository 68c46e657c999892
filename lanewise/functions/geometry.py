"""Plane geometry and box forms as column expressions. Points are struct(x, y); everything stays inside generated code."""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column | float, y: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(lit(x).cast("double").alias("x"), lit(y).cast("double").alias("y"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def polygon(points: list[tuple[float, float]]) -> Column:
    return F.array(*[point(x, y) for x, y in points])


def foot_point(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Foot of the perpendicular from p on the infinite line through a and b; null where a equals b."""
    dx, dy = bx - ax, by - ay
    norm = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    k = ((px - ax) * dx + (py - ay) * dy) / norm
    return ax + k * dx, ay + k * dy


def affine(x: Column, y: Column, m: list[Column]) -> tuple[Column, Column]:
    """m: a, b, tx, c, d, ty, the rows of a 2x3 matrix."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def solve_affine(src: list[tuple[Column, Column]], dst: list[tuple[Column, Column]]) -> list[Column]:
    """The six numbers of the affine map that takes three points to three points (Cramer's rule); null if they lie on a line."""
    (x1, y1), (x2, y2), (x3, y3) = src
    det = F.nullif(x1 * (y2 - y3) + x2 * (y3 - y1) + x3 * (y1 - y2), F.lit(0.0))
    out = []
    for axis in (0, 1):
        u1, u2, u3 = (d[axis] for d in dst)
        out.append((u1 * (y2 - y3) + u2 * (y3 - y1) + u3 * (y1 - y2)) / det)
        out.append((x1 * (u2 - u3) + x2 * (u3 - u1) + x3 * (u1 - u2)) / det)
        out.append((x1 * (y2 * u3 - y3 * u2) + x2 * (y3 * u1 - y1 * u3) + x3 * (y1 * u2 - y2 * u1)) / det)
    return out


def metres(px: Column, py: Column, origin: tuple[float, float], x_axis: tuple[float, float], y_axis: tuple[float, float], per_pixel: float) -> tuple[Column, Column]:
    """Pixels to metres on an annotated frame of reference: the x axis runs from origin to x_axis, y is its perpendicular on y_axis's side."""
    ux, uy = x_axis[0] - origin[0], x_axis[1] - origin[1]
    n = math.hypot(ux, uy)
    ux, uy = ux / n, uy / n
    side = 1.0 if ux * (y_axis[1] - origin[1]) - uy * (y_axis[0] - origin[0]) >= 0 else -1.0
    dx, dy = px - origin[0], py - origin[1]
    return per_pixel * (dx * ux + dy * uy), per_pixel * side * (dy * ux - dx * uy)


def edges(ring: Column) -> Column:
    """Each point with the one after it, the first after the last."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def polygon_area(ring: Column) -> Column:
    """Half the absolute cross sum; 0 for fewer than three points."""
    total = F.aggregate(edges(ring), F.lit(0.0), lambda acc, e: acc + (e.a.x * e.b.y - e.b.x * e.a.y))
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(total) / 2)


def polygon_centre(ring: Column) -> tuple[Column, Column]:
    """Centre of gravity by signed areas, truncated to integers; null for no area."""
    cross = lambda e: e.a.x * e.b.y - e.b.x * e.a.y
    double = F.nullif(F.aggregate(edges(ring), F.lit(0.0), lambda acc, e: acc + cross(e)), F.lit(0.0))
    weighted = lambda c: F.aggregate(edges(ring), F.lit(0.0), lambda acc, e: acc + (e.a[c] + e.b[c]) * cross(e))
    return tuple((weighted(c) / (3 * double)).cast("int") for c in ("x", "y"))


def odd_crossings(px: Column, py: Column, edges: Column) -> Column:
    """Whether a ray to the left crosses an odd number of the edges (struct of a and b)."""

    def crosses(e: Column) -> Column:
        spans = ((e.a.y < py) & (py <= e.b.y)) | ((e.b.y < py) & (py <= e.a.y))
        return spans & (e.a.x + (py - e.a.y) / F.nullif(e.b.y - e.a.y, F.lit(0.0)) * (e.b.x - e.a.x) < px)

    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + F.when(crosses(e), 1).otherwise(0)) % 2 == 1


def on_edges(px: Column, py: Column, edges: Column) -> Column:
    """On an edge or an end of one."""

    def on_edge(e: Column) -> Column:
        cross = (e.b.x - e.a.x) * (py - e.a.y) - (e.b.y - e.a.y) * (px - e.a.x)
        in_box = px.between(F.least(e.a.x, e.b.x), F.greatest(e.a.x, e.b.x)) & py.between(F.least(e.a.y, e.b.y), F.greatest(e.a.y, e.b.y))
        return (cross == 0) & in_box

    return F.exists(edges, on_edge)


def inside(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd rule. Points on the boundary, vertices included, are outside."""
    return odd_crossings(px, py, edges(ring)) & ~on_boundary(px, py, ring)


def on_boundary(px: Column, py: Column, ring: Column) -> Column:
    """On an edge or a vertex."""
    return on_edges(px, py, edges(ring))


def inside_ring(px: Column, py: Column, ring: list[tuple[float, float]]) -> Column:
    """inside() for a ring that is known beforehand: its edges become plain arithmetic, which is compiled."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        ax, ay, bx, by = map(float, (ax, ay, bx, by))
        if ay != by:
            spans = (py > min(ay, by)) & (py <= max(ay, by))
            crossings += F.when(spans & (ax + (py - ay) / (by - ay) * (bx - ax) < px), 1).otherwise(0)
        level = ((bx - ax) * (py - ay) - (by - ay) * (px - ax)) == 0
        on_edge |= level & px.between(min(ax, bx), max(ax, bx)) & py.between(min(ay, by), max(ay, by))
    xs, ys = [float(x) for x, _ in ring], [float(y) for _, y in ring]
    near = px.between(min(xs), max(xs)) & py.between(min(ys), max(ys))
    return F.coalesce(near & (crossings % 2 == 1) & ~on_edge, F.lit(False))


def project_on_known_line(px: Column, py: Column, line: list[tuple[float, float]]) -> Column:
    """project_on_line() for a line that is known beforehand, as plain arithmetic."""
    parts, run = [], 0.0
    for i, ((ax, ay), (bx, by)) in enumerate(zip(line, line[1:], strict=False)):
        dx, dy = bx - ax, by - ay
        length = math.hypot(dx, dy)
        k = ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy) if length else F.lit(0.0)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), k))
        dist = F.hypot(px - ax - t * dx, py - ay - t * dy)
        side = F.signum(dx * (py - ay) - dy * (px - ax))
        parts.append(F.struct(dist.alias("dist"), F.lit(i).alias("i"), (run + t * length).alias("pos"), side.alias("side")))
        run += length
    return F.array_min(F.array(*parts))


def project_on_line(px: Column, py: Column, line: Column) -> Column:
    """struct(dist, pos, side): distance to a polyline, position along it of the nearest point, +1 on the left of its segment and -1 on the right.

    Of equally near segments the first counts.
    """
    pairs = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    start = F.struct(F.lit(0.0).alias("run"), F.lit(float("inf")).alias("dist"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("side"))

    def step(acc: Column, e: Column) -> Column:
        dx, dy = e.b.x - e.a.x, e.b.y - e.a.y
        length = F.hypot(dx, dy)
        k = F.coalesce(((px - e.a.x) * dx + (py - e.a.y) * dy) / F.nullif(length * length, F.lit(0.0)), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), k))
        dist = F.hypot(px - e.a.x - t * dx, py - e.a.y - t * dy)
        nearer = dist < acc.dist
        side = F.signum(dx * (py - e.a.y) - dy * (px - e.a.x))
        return F.struct(
            (acc.run + length).alias("run"),
            F.least(dist, acc.dist).alias("dist"),
            F.when(nearer, acc.run + t * length).otherwise(acc.pos).alias("pos"),
            F.when(nearer, side).otherwise(acc.side).alias("side"),
        )

    return F.aggregate(pairs, start, step, lambda acc: F.struct(acc.dist.alias("dist"), acc.pos.alias("pos"), acc.side.alias("side")))


def corners(cx: Column, cy: Column, w: Column, h: Column, theta: Column) -> list[Column]:
    """x1, y1 .. x4, y4 of a rotated box: centre plus (+,+), (+,-), (-,-), (-,+) of its half sides."""
    vx, vy = w / 2 * F.cos(theta), w / 2 * F.sin(theta)
    ux, uy = -h / 2 * F.sin(theta), h / 2 * F.cos(theta)
    out = []
    for a, b in ((1, 1), (1, -1), (-1, -1), (-1, 1)):
        out += [cx + a * vx + b * ux, cy + a * vy + b * uy]
    return out


def bounds(c: list[Column]) -> list[Column]:
    """left, top, right, bottom of four corners."""
    xs, ys = c[0::2], c[1::2]
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def wrap_half_turn(theta: Column) -> Column:
    """An angle in [-pi/2, pi/2)."""
    return F.pmod(theta + math.pi / 2, F.lit(math.pi)) - math.pi / 2


def long_edge(w: Column, h: Column, theta: Column) -> tuple[Column, Column, Column]:
    """w >= h; a swap turns the box by a quarter."""
    return F.greatest(w, h), F.least(w, h), wrap_half_turn(theta + F.when(w < h, math.pi / 2).otherwise(0.0))


def overlap_area(a: list[Column], b: list[Column]) -> Column:
    """Of two boxes left, top, right, bottom."""
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: list[Column], b: list[Column]) -> Column:
    both = overlap_area(a, b)
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return both / F.nullif(area(a) + area(b) - both, F.lit(0.0))


def to_state(l: Column, t: Column, r: Column, b: Column) -> dict[str, Column]:
    """Centre, area and ratio of an upright box."""
    return {"cx": (l + r) / 2, "cy": (t + b) / 2, "area": (r - l) * (b - t), "ratio": (r - l) / F.nullif(b - t, F.lit(0.0))}


def from_state(cx: Column, cy: Column, area: Column, ratio: Column) -> list[Column]:
    """left, top, right, bottom; null where area and ratio make no box."""
    w = F.when(area * ratio > 0, F.sqrt(area * ratio))
    return [cx - w / 2, cy - area / w / 2, cx + w / 2, cy + area / w / 2]


def to_corner_size(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    """left, top, width, height of a box given by its centre."""
    return [cx - w / 2, cy - h / 2, w, h]


def to_height_form(l: Column, t: Column, w: Column, h: Column) -> list[Column]:
    """Centre, aspect and height of a box left, top, width, height."""
    return [l + w / 2, t + h / 2, w / F.nullif(h, F.lit(0.0)), h]


def clipped(l: Column, t: Column, w: Column, h: Column, width: int, height: int) -> list[Column]:
    """left, top, right, bottom as integers inside an image of that size."""
    whole = lambda v: v.cast("int")
    return [F.greatest(whole(l), F.lit(0)), F.greatest(whole(t), F.lit(0)), F.least(whole(l + w), F.lit(width - 1)), F.least(whole(t + h), F.lit(height - 1))]


def convex_hull(points: Column) -> Column:
    """The corners of the convex figure around an array of points, from the leftmost, against the clock (y upwards); no three on a line, none twice.

    Both halves grow in the order of x: a new point takes the place of the corners that it makes superfluous, which are the last ones of a half.
    """

    def half(ordered: Column) -> Column:
        def grown(h: Column, p: Column) -> Column:
            def turns_left(j: Column) -> Column:
                a, b = F.get(h, j - 2), F.get(h, j - 1)
                return (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) > 0

            kept = F.when(F.size(h) < 2, F.size(h)).otherwise(F.coalesce(F.array_max(F.filter(F.sequence(F.lit(2), F.greatest(F.size(h), F.lit(2))), turns_left)), F.lit(1)))
            return F.concat(F.slice(h, F.lit(1), kept), F.array(p))

        none = F.slice(ordered, 1, 0)
        return F.aggregate(ordered, none, grown)

    def whole(ordered: Column) -> Column:
        lower, upper = half(ordered), half(F.reverse(ordered))
        inner = lambda h: F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0)))
        return F.when(F.size(ordered) < 3, ordered).otherwise(F.concat(inner(lower), inner(upper)))

    plain = F.transform(points, lambda p: point(p.x, p.y))
    return let(F.array_sort(F.array_distinct(plain)), whole)
