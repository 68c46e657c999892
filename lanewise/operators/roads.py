"""Annotated roads: lane lines, strips between them, axes, chained driving lines; and the text forms of detections and matches."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import geometry as G


#: Positions of a line whose chain is followed within one row.
IN_A_ROW = 64


def between_lines(points: DataFrame, lines: list[tuple[int, list[tuple[float, float]]]]) -> DataFrame:
    """points with lane: the smaller number of the two nearest lane lines if their numbers are neighbours, else -1."""
    every = [F.struct(G.project_on_known_line(F.col("x"), F.col("y"), line).dist.alias("dist"), F.lit(n).alias("n")) for n, line in lines]
    a, b = (F.get(F.sort_array(F.array(*every)), F.lit(i)).n for i in (0, 1))
    return points.withColumn("lane", F.when(F.abs(a - b) == 1, F.least(a, b)).otherwise(-1))


def strips(lines: DataFrame, by: str) -> DataFrame:
    """The figure between each line and the one of the next number: the first line and the second reversed. lines: by, number, points."""
    w = Window.partitionBy(by).orderBy("number")
    after = lines.withColumns({"_n": F.lead("number").over(w), "_p": F.lead("points").over(w)})
    return after.filter(F.col("_n") == F.col("number") + 1).select(by, "number", F.concat("points", F.reverse("_p")).alias("ring"))


def rebased(positions: DataFrame, by: list[str]) -> DataFrame:
    """A sub line's positions on the main line's scale: the greatest difference at shared places is added. positions: by, main, sub."""
    shift = positions.groupBy(*by).agg(F.max(F.col("main") - F.col("sub")).alias("_shift"))
    return positions.join(shift, by).withColumn("position", F.col("sub") + F.col("_shift")).drop("_shift")


def axis_ticks(scenes: DataFrame, step_px: Column, direction: tuple[float, float], width: Column, height: Column) -> DataFrame:
    """Places of each step along an axis from (ox, oy), truncated, as long as they are in the image. The last step follows from the image's sides."""
    reach = [(F.abs("o" + c) + side + 1) / (step_px * abs(d)) for c, d, side in (("x", direction[0], width), ("y", direction[1], height)) if d]
    last = F.ceil(F.least(*reach) if len(reach) > 1 else reach[0]).cast("int")
    ticks = scenes.withColumn("tick", F.explode(F.sequence(F.lit(0), last)))
    x = (F.col("ox") + F.col("tick") * step_px * direction[0]).cast("int")
    y = (F.col("oy") + F.col("tick") * step_px * direction[1]).cast("int")
    return ticks.withColumns({"tick_x": x, "tick_y": y}).filter(F.col("tick_x").between(0, width - 1) & F.col("tick_y").between(0, height - 1))


def line_ticks(lines: DataFrame, by: list[str], every: float) -> DataFrame:
    """by, d, x, y: the point at each multiple of `every` along each line, its end excluded. lines: by, points."""
    ends = F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.hypot(b.x - a.x, b.y - a.y).alias("n")))
    start = F.array(F.struct(F.lit(0.0).alias("at"), F.lit(None).cast("double").alias("n"), *[F.lit(None).cast("double").alias(c) for c in ("x", "y", "dx", "dy")]))

    def grown(acc: Column, e: Column) -> Column:
        last = F.element_at(acc, -1)
        at = last.at + F.coalesce(last.n, F.lit(0.0))
        return F.concat(acc, F.array(F.struct(at.alias("at"), e.n.alias("n"), e.a.x.alias("x"), e.a.y.alias("y"), (e.b.x - e.a.x).alias("dx"), (e.b.y - e.a.y).alias("dy"))))

    segments = lines.filter(F.size("points") > 1).select(*by, F.explode(F.aggregate(ends, start, grown)).alias("s")).filter("s.n > 0")
    lo, hi = F.ceil(F.col("s.at") / every), F.ceil((F.col("s.at") + F.col("s.n")) / every)
    ticks = segments.filter(lo < hi).withColumn("k", F.explode(F.sequence(lo, hi - 1)))
    d = F.col("k") * every
    share = (d - F.col("s.at")) / F.col("s.n")
    return ticks.select(*by, d.cast("double").alias("d"), (F.col("s.x") + share * F.col("s.dx")).alias("x"), (F.col("s.y") + share * F.col("s.dy")).alias("y"))


def driving_lines(shapes: DataFrame) -> DataFrame:
    """line, position, points, region, base_x, base_y, base_distance and connects (from, to, x, y) of labels drivingline_{line}_{position}_{what}.

    shapes: label, points. What is `line`, `region`, `point_{distance}` (the line's one base) or `connect_{from}_{to}`. The last shape of a kind counts.
    """
    part = lambda i: F.get(F.split("label", "_"), F.lit(i))
    rows = shapes.filter(F.col("label").startswith("drivingline")).select(
        part(1).alias("line"), part(2).alias("position"), part(3).alias("what"), part(4).alias("p"), part(5).alias("q"), "points", *(["shape_no"] if "shape_no" in shapes.columns else [F.lit(0).alias("shape_no")])
    )
    last = lambda what, value: F.max_by(F.when(F.col("what") == what, value), F.when(F.col("what") == what, F.col("shape_no")))
    first = F.get("points", F.lit(0))
    link = F.struct("shape_no", F.col("p").alias("from"), F.col("q").alias("to"), first.x.alias("x"), first.y.alias("y"))
    out = rows.groupBy("line", "position").agg(
        last("line", F.col("points")).alias("points"),
        last("region", F.col("points")).alias("region"),
        last("point", first.x).alias("base_x"),
        last("point", first.y).alias("base_y"),
        last("point", F.col("p").cast("double")).alias("base_distance"),
        F.sort_array(F.collect_list(F.when(F.col("what") == "connect", link))).alias("connects"),
        F.count_if(F.col("what") == "point").alias("bases"),
    )
    return out.withColumn("connects", F.transform("connects", lambda c: F.struct(c["from"].alias("from"), c.to.alias("to"), c.x.alias("x"), c.y.alias("y"))))


def line_bases(lines: DataFrame, per_pixel: DataFrame) -> DataFrame:
    """line, position, points, region, base_x, base_y, base_pos (its place along points), base_distance, per_pixel of every position that a line's base leads to.

    lines: from driving_lines(); per_pixel: position, per_pixel. A position's way on is the link whose end is another position; its own place is the link
    that ends at it. The distance between both, along its line, is added up from the base: within a row where lines have few positions, by doubling pointers otherwise.
    """
    here = lines.join(per_pixel, "position")
    own = F.get(F.filter("connects", lambda c: c.to == F.col("position")), F.lit(0))
    away = F.get(F.filter("connects", lambda c: c.to != F.col("position")), F.lit(0))
    here = here.withColumns({"_at": own, "_next": away})
    start_x, start_y = F.coalesce("base_x", F.col("_at.x")), F.coalesce("base_y", F.col("_at.y"))
    here = here.withColumns({"_x": start_x, "_y": start_y})
    along = lambda x, y: G.project_on_line(x, y, F.col("points")).pos
    step = (along(F.col("_next.x"), F.col("_next.y")) - along(F.col("_x"), F.col("_y"))) * F.col("per_pixel")
    parts = here.select("line", "position", F.col("_next.to").alias("next"), F.coalesce(step, F.lit(0.0)).alias("length"), F.col("base_distance").isNotNull().alias("is_base"))
    longest = parts.groupBy("line").count().agg(F.max("count")).first()[0] or 0
    far = _along_rows(parts) if longest <= IN_A_ROW else _along_tables(parts)
    base = here.filter("base_distance is not null").select("line", F.col("base_distance").alias("_first"))
    out = here.join(far, ["line", "position"]).join(base, "line")
    return out.select("line", "position", "points", "region", F.col("_x").alias("base_x"), F.col("_y").alias("base_y"), along(F.col("_x"), F.col("_y")).alias("base_pos"), (F.col("_first") + F.col("distance")).alias("base_distance"), "per_pixel")


def _along_rows(parts: DataFrame) -> DataFrame:
    """line, position, distance: each line's positions are one row, and its chain is followed there from the base."""
    held = parts.groupBy("line").agg(F.collect_list(F.struct("position", "next", "length", "is_base")).alias("p"))

    def onward(way: Column, _: Column) -> Column:
        last = F.element_at(way, -1)
        part = F.get(F.filter("p", lambda x: x.position == last.position), F.lit(0))
        more = F.concat(way, F.array(F.struct(part.next.alias("position"), (last.distance + part.length).alias("distance"))))
        return F.when(part.next.isNotNull() & ~F.exists(way, lambda w: w.position == part.next), more).otherwise(way)

    way = lambda b: F.aggregate(F.sequence(F.lit(1), F.size("p")), F.array(F.struct(b.position.alias("position"), F.lit(0.0).alias("distance"))), onward)
    ways = F.flatten(F.transform(F.filter("p", lambda x: x.is_base), way))
    return held.select("line", F.explode(ways).alias("w")).select("line", "w.position", "w.distance")


def _along_tables(parts: DataFrame) -> DataFrame:
    """The same by joins, for lines of any length."""
    from lanewise.operators.graphs import distances

    node = lambda position: F.when(F.col(position).isNotNull(), F.struct(F.col("line").alias("line"), F.col(position).alias("position")))
    return distances(parts.select(node("position").alias("node"), node("next").alias("next"), "length", "is_base")).select("node.line", "node.position", "distance")


def on_driving_lines(points: DataFrame, bases: DataFrame) -> DataFrame:
    """points (line, position, x, y) with line_pos and line_offset on the line of their position; null outside its region, if it has one."""
    both = points.join(bases, ["line", "position"], "left")
    inside = F.coalesce(G.inside(F.col("x"), F.col("y"), F.col("region")), F.lit(True))
    on = G.project_on_line(F.col("x"), F.col("y"), F.col("points"))
    both = both.withColumn("_on", F.when(inside & F.col("points").isNotNull(), on))
    pos = (F.col("_on.pos") - F.col("base_pos")) * F.col("per_pixel") + F.col("base_distance")
    return both.withColumns({"line_pos": pos, "line_offset": F.col("_on.dist") * F.col("per_pixel")}).drop("_on", *[c for c in bases.columns if c not in ("line", "position")])


def calibration_points(shapes: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """Points of the first shape of each key whose label begins with `prefix`. shapes: by, shape_no, label, points."""
    return shapes.filter(F.col("label").startswith(prefix)).groupBy(*by).agg(F.min_by("points", "shape_no").alias("points"))


def by_number(lines: DataFrame, label: str = "label") -> DataFrame:
    """lines with number, the integer after the last underscore of the label, in its order."""
    number = F.element_at(F.split(F.col(label), "_"), -1)
    return lines.withColumn("number", number.try_cast("int")).orderBy("number", label)


def road_settings(shapes: DataFrame, by: str = "path") -> DataFrame:
    """A row a file of annotated shapes: what a road's settings are made of. shapes: by, shape_no, label, points.

    fixed and road (polygons, truncated to integers, for stabilising and for detection), lanes (number, points), lane_lines, intersections and driving_lines (label, points),
    per_pixel (mean metres by pixels over `length_*`), origin, x_axis (end), y_axis, and the axis as vectors: along x, and from the foot of y's point on x to it.
    """
    p = lambda i: F.get("points", F.lit(i))
    tail = F.element_at(F.split("label", "_"), -1)
    whole = F.transform("points", lambda q: G.point(q.x.cast("int"), q.y.cast("int")))
    item = lambda what, value: F.sort_array(F.collect_list(F.when(what, F.struct("shape_no", value.alias("v")))))
    values = lambda c: F.transform(c, lambda s: s.v)
    named = F.struct("label", "points")
    is_length = F.col("label").startswith("length")
    metres = F.when(is_length, tail.try_cast("double") / F.hypot(p(0).x - p(1).x, p(0).y - p(1).y))
    last = lambda label, value: F.max_by(F.when(F.col("label") == label, value), F.when(F.col("label") == label, F.col("shape_no")))
    out = shapes.groupBy(by).agg(
        values(item(F.col("label") == "fp", whole)).alias("fixed"),
        values(item(F.col("label") == "road", whole)).alias("road"),
        values(item(F.col("label").startswith("lane_"), F.struct(tail.try_cast("int").alias("number"), F.col("points").alias("points")))).alias("lanes"),
        values(item(F.col("label").startswith("laneline_"), named)).alias("lane_lines"),
        values(item(F.col("label").startswith("int"), named)).alias("intersections"),
        values(item(F.col("label").startswith("drivingline"), named)).alias("driving_lines"),
        F.avg(metres).alias("per_pixel"),
        last("x", p(0)).alias("origin"),
        last("x", p(1)).alias("x_axis"),
        last("y", p(0)).alias("y_axis"),
    )
    o, e, y = F.col("origin"), F.col("x_axis"), F.col("y_axis")
    fx, fy = G.foot_point(y.x, y.y, o.x, o.y, e.x, e.y)
    return out.withColumns({"x_vector": G.point(e.x - o.x, e.y - o.y), "y_vector": G.point(y.x - fx, y.y - fy)})


def detection_line(name: Column, score: Column, box: list[Column]) -> Column:
    """`class confidence left top right bottom`, places as integers."""
    return F.concat_ws(" ", name, F.format_string("%.6f", score), *[b.cast("int").cast("string") for b in box])


def held_out(items: DataFrame, cls: str, key: str, share: float = 0.2) -> DataFrame:
    """items with class_no (by name) and part: a share of each class, in the order of the key's digest, is for validation."""
    own = Window.partitionBy(cls)
    place = F.row_number().over(own.orderBy(F.md5(F.col(key).cast("string"))))
    names = items.select(cls).distinct().withColumn("class_no", F.row_number().over(Window.orderBy(cls)) - 1)
    out = items.withColumn("part", F.when(place <= F.ceil(F.count("*").over(own) * share), "val").otherwise("train"))
    return out.join(names, cls)
