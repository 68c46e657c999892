"""Points placed on roads that are tables: lanes, lane lines and driving lines of any number of videos, in one job.

Roads of few edges travel to the points of their video: both are dealt by video, and a task meets them in whole columns. Where a road has many edges, polygons are covered by the cells of a grid. A cell that no edge touches is inside or outside as a whole, so its points need no test; a border cell keeps the edges of its row, all that
the test of a point in it can meet. One row a cell holds what its polygons say, in their order: a point finds its cell by an equi-join and never becomes several rows.
Cells and videos that hold many points are counted first (a partial sum) and split by salt, so one busy place isn't one task.
Covers and roads grow with the videos, which Spark's estimates of their size don't see: they are never broadcast.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lanewise.functions import geometry as G, road_points as P

#: Points of a cell that one task takes, and the number of heavier cells that can be: a thousandth of all points makes one, too.
MANY, HEAVY = 100_000, 1_000
#: Most edges of a road whose points look at all of them.
EDGES = 2_048


def _edges_by_row(polygons: DataFrame, by: str, size: float) -> DataFrame:
    """polygons with edges, one row for each row of cells (cell_y) that the polygon's bounds meet: edges are those that touch the row, a hair's breadth about it included."""
    ring = F.col("ring")
    ys, xs = F.transform(ring, lambda p: p.y), F.transform(ring, lambda p: p.x)
    cell = lambda v: F.floor(v / size)
    rows = polygons.filter(F.size("ring") >= 3).select(
        by, "ord", "lane", G.edges(ring).alias("edges"), cell(F.array_min(xs)).alias("first_x"), cell(F.array_max(xs)).alias("last_x"), cell(F.array_min(ys)).alias("first_y"), cell(F.array_max(ys)).alias("last_y")
    )
    rows = rows.withColumn("cell_y", F.explode(F.sequence(F.col("first_y"), F.col("last_y"))))
    low, high = F.col("cell_y") * size - size * 1e-6, (F.col("cell_y") + 1) * size + size * 1e-6
    touching = F.filter("edges", lambda e: (F.least(e.a.y, e.b.y) <= high) & (F.greatest(e.a.y, e.b.y) >= low))
    return rows.withColumn("edges", touching).drop("first_y", "last_y")


def cell_cover(polygons: DataFrame, by: str = "video_id", size: float = 32.0) -> DataFrame:
    """by, cell_x, cell_y, entries: in the order of ord, the polygons that cover the cell or have a border in it. polygons: by, ord, lane, ring.

    An entry is (ord, lane, edges); edges is null where the whole cell is inside. Polygons of fewer than three points cover nothing.
    """
    rows = _edges_by_row(polygons, by, size).withColumn("cell_x", F.explode(F.sequence(F.col("first_x"), F.col("last_x"))))
    half = size / 2 * (1 + 1e-5)
    mid_x, mid_y = (F.col("cell_x") + 0.5) * size, (F.col("cell_y") + 0.5) * size

    def touches(e: Column) -> Column:
        """Edge and cell have a point in common: their bounds meet, and the cell's corners aren't all on one side of the edge."""
        near = (F.least(e.a.x, e.b.x) <= mid_x + half) & (F.greatest(e.a.x, e.b.x) >= mid_x - half) & (F.least(e.a.y, e.b.y) <= mid_y + half) & (F.greatest(e.a.y, e.b.y) >= mid_y - half)
        dx, dy = e.b.x - e.a.x, e.b.y - e.a.y
        return near & (F.abs(dx * (mid_y - e.a.y) - dy * (mid_x - e.a.x)) <= (F.abs(dx) + F.abs(dy)) * half * (1 + 1e-9))

    border = F.exists("edges", touches)
    rows = rows.withColumn("border", border).filter(F.col("border") | G.odd_crossings(mid_x, mid_y, F.col("edges")))
    entry = F.struct("ord", "lane", F.when(F.col("border"), F.col("edges")).alias("edges"))
    return rows.groupBy(by, "cell_x", "cell_y").agg(F.collect_list(entry).alias("entries")).withColumn("entries", F.array_sort("entries", _by_ord))


def _by_ord(a: Column, b: Column) -> Column:
    return F.when(a.ord < b.ord, -1).when(a.ord > b.ord, 1).otherwise(0)


def heavy_keys(rows: DataFrame, keys: list[str], many: int) -> tuple[DataFrame, DataFrame | None]:
    """keys and count of all keys, and keys and _salts of those with more than `many` rows, and a thousandth of all; None where there are none."""
    counts = rows.groupBy(*keys).count()
    total, most = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    each = max(many, total // HEAVY)
    # At most HEAVY rows, as each has more than a thousandth of all points.
    return counts, counts.filter(F.col("count") > each).select(*keys, F.ceil(F.col("count") / each).cast("int").alias("_salts")) if most > each else None


def _salted(points: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    """points with _salt. By all columns: a task that runs again salts its rows as before."""
    return points.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")


def _for_salts(rows: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    """rows once for each _salt of their key."""
    return rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")


def salted_join(points: DataFrame, cells: DataFrame, keys: list[str], many: int = MANY, counted: DataFrame | None = None, hint: str | None = None) -> DataFrame:
    """points with what cells (one row a key) hold for their key, if anything. Keys with more than `many` points, and a thousandth of all, are split over as many tasks as that makes.

    counted: rows of the same keys that are cheaper to count than points. hint: how Spark is to join cells.
    """
    _, heavy = heavy_keys(points if counted is None else counted, keys, many)
    told = lambda df: df.hint(hint) if hint else df
    if heavy is None:
        return points.join(told(cells), keys, "left")
    return _salted(points, heavy, keys).join(told(_for_salts(cells, heavy, keys)), [*keys, "_salt"], "left").drop("_salt")


def in_first_polygon(points: DataFrame, cover: DataFrame, by: str = "video_id", size: float = 32.0, x: str = "x", y: str = "y", many: int = MANY) -> DataFrame:
    """points with lane and place (its ord) of the first polygon of their video that holds them; nulls for none. Points on a border are outside, as in geometry.inside()."""
    px, py = F.col(x), F.col(y)
    there = ~F.isnan(px) & ~F.isnan(py)
    keyed = points.withColumns({"cell_x": F.when(there, F.floor(px / size)), "cell_y": F.when(there, F.floor(py / size))})
    both = salted_join(keyed, cover, [by, "cell_x", "cell_y"], many, hint="merge")
    holds = lambda e: e.edges.isNull() | (G.odd_crossings(px, py, e.edges) & ~G.on_edges(px, py, e.edges))
    first = F.get(F.filter("entries", holds), F.lit(0))
    return both.withColumns({"lane": first.lane, "place": first.ord}).drop("entries", "cell_x", "cell_y")


def few_edges(polygons: DataFrame, by: str) -> bool:
    """Whether no road has more than EDGES edges."""
    return (polygons.groupBy(by).agg(F.sum(F.size("ring")).alias("n")).agg(F.max("n")).first()[0] or 0) <= EDGES


def on_roads(points: DataFrame, polygons: DataFrame, by: str, x: str, y: str, many: int, lines: bool = False) -> DataFrame:
    """points with the lane of the first polygon of their video that holds them, with lines also with line_pos and line_offset along its line; nulls for none. For roads of few edges.

    Points and polygons are dealt by video, the polygons first; a task holds one road at a time, and the points of a batch meet it together.
    """
    counts, heavy = heavy_keys(points, [by], many)
    dealt = points.withColumn("_salt", F.lit(0)) if heavy is None else _salted(points, heavy, [by])
    # Points without a video meet no road: any task may take them.
    dealt = dealt.withColumn("_salt", F.when(F.col(by).isNull(), F.pmod(F.xxhash64(*points.columns), F.lit(HEAVY)).cast("int")).otherwise(F.col("_salt")))
    line = ["line", "base", "start", "per_pixel"] if lines else []
    spot = lambda c: F.transform(c, lambda p: F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y"))).alias(c)
    road = F.struct("ord", "lane", spot("ring"), *[spot(c) if c == "line" else F.col(c).cast("double").alias(c) for c in line]).alias("_road")
    # Only roads that have points travel.
    roads = counts.select(by).join(polygons.filter(F.size("ring") >= 3).select(by, road).hint("merge"), by)
    roads = roads.withColumn("_salt", F.lit(0)) if heavy is None else _for_salts(roads, heavy, [by])
    new = ["lane", "line_pos", "line_offset"] if lines else ["lane"]
    kept = [c for c in points.columns if c not in new]
    rows = dealt.select("_salt", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *kept).unionByName(roads, allowMissingColumns=True).select(F.col("_road").isNull().alias("_point"), "_salt", "_x", "_y", "_road", *kept)
    schema = T.StructType([T.StructField(c, points.schema[c].dataType) for c in kept] + [T.StructField(c, polygons.schema["lane"].dataType if c == "lane" else T.DoubleType()) for c in new])
    lane_type, of = to_arrow_type(polygons.schema["lane"].dataType), [*["_point", "_salt", "_x", "_y", "_road"], *kept].index(by)

    def met(batch: pa.RecordBatch, road: P.Road | None) -> pa.RecordBatch:
        columns = [batch.column(i) for i in range(5, batch.num_columns)]
        if road is None:
            found = [pa.nulls(batch.num_rows, lane_type), *[pa.nulls(batch.num_rows, pa.float64()) for _ in new[1:]]]
        else:
            px, py = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            at = road.first_that_holds(px, py)
            found = [road.lanes.take(pa.array(at, mask=at < 0)), *([pa.array(v, mask=at < 0) for v in road.along(px, py, at)] if lines else [])]
        return pa.RecordBatch.from_arrays([*columns, *found], schema.names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, road = None, [], None
        for batch in batches:
            for lo, hi in P.runs([batch.column(of), batch.column(1)]):
                run = batch.slice(lo, hi - lo)
                now = (run.column(of)[0], run.column(1)[0])
                if key is None or not all(a.equals(b) for a, b in zip(now, key, strict=True)):
                    key, rows, road = now, [], None
                n = run.num_rows - run.column(0).true_count
                if n:
                    rows.append(run.column(4).slice(0, n))
                if n < run.num_rows:
                    if rows:
                        road, rows = P.Road(pa.concat_arrays(rows)), []
                    yield met(run.slice(n), road)

    return rows.repartition(by, "_salt").sortWithinPartitions(by, "_salt", "_point").mapInArrow(walk, schema)


def lanes_from_table(points: DataFrame, polygons: DataFrame, by: str = "video_id", size: float = 32.0, x: str = "x", y: str = "y", many: int = MANY) -> DataFrame:
    """points with lane: the first of their video's polygons (by, ord, lane, ring) that holds the point, else -1. size: of the cells of roads with many edges."""
    if few_edges(polygons, by):
        placed = on_roads(points, polygons, by, x, y, many)
    else:
        placed = in_first_polygon(points, cell_cover(polygons, by, size), by, size, x, y, many).drop("place")
    return placed.withColumn("lane", F.coalesce("lane", F.lit(-1).cast(polygons.schema["lane"].dataType)))


def _of_video(points: DataFrame, lines: DataFrame, by: str, many: int, counted: DataFrame, *columns: str, hint: str | None = None) -> DataFrame:
    """points with lines, an array of the lines of their video: a road's lines are few, so its row is small; a busy video is split by salt."""
    return salted_join(points, lines.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("lines")), [by], many, counted, hint)


def between_lines_from_table(points: DataFrame, lines: DataFrame, by: str = "video_id", x: str = "x", y: str = "y", many: int = MANY) -> DataFrame:
    """points with lane: the smaller number of the two nearest lane lines of their video if their numbers are neighbours, else -1, also where there are fewer. lines: by, number, points."""
    both = _of_video(points, lines, by, many, points, "number", "points")
    near = F.sort_array(F.transform("lines", lambda line: F.struct(G.project_on_line(F.col(x), F.col(y), line.points).dist.alias("dist"), line.number.alias("number"))))
    a, b = F.get(near, F.lit(0)).number, F.get(near, F.lit(1)).number
    return both.withColumn("lane", F.when(F.abs(a - b) == 1, F.least(a, b)).otherwise(-1)).drop("lines")


def along_lines_from_table(points: DataFrame, regions: DataFrame, by: str = "video_id", size: float = 32.0, x: str = "x", y: str = "y", many: int = MANY) -> DataFrame:
    """points with lane, line_pos and line_offset: the first region of their video that holds them, and the place along its line, in its units, and beside it; nulls outside all regions.

    regions: by, ord, lane, ring, points (the line), base (the place along points that counts as start), start, per_pixel.
    """
    if few_edges(regions, by):
        return on_roads(points, regions.withColumnRenamed("points", "line"), by, x, y, many, lines=True)
    placed = in_first_polygon(points, cell_cover(regions, by, size), by, size, x, y, many)
    both = _of_video(placed, regions.withColumnRenamed("points", "line"), by, many, points, "ord", "line", "base", "start", "per_pixel", hint="merge")
    own = F.get(F.filter("lines", lambda r: r.ord == F.col("place")), F.lit(0))
    both = both.withColumn("_own", own).drop("lines", "place")
    both = both.withColumn("_on", F.when(F.col("_own").isNotNull(), G.project_on_line(F.col(x), F.col(y), F.col("_own.line"))))
    pos = (F.col("_on.pos") - F.col("_own.base")) * F.col("_own.per_pixel") + F.col("_own.start")
    return both.withColumns({"line_pos": pos, "line_offset": F.col("_on.dist") * F.col("_own.per_pixel")}).drop("_own", "_on")


def strips_as_polygons(lines: DataFrame, by: str = "video_id") -> DataFrame:
    """by, ord, lane, ring: the strips between lane lines of neighbouring numbers, as polygons for lanes_from_table(). lines: by, number, points."""
    w = Window.partitionBy(by).orderBy("number")
    after = lines.withColumns({"_n": F.lead("number").over(w), "_p": F.lead("points").over(w)}).filter(F.col("_n") == F.col("number") + 1)
    return after.select(by, F.col("number").alias("ord"), F.col("number").alias("lane"), F.concat("points", F.reverse("_p")).alias("ring"))
