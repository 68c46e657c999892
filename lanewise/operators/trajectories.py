"""Trajectories: building, describing, comparing, joining and fusing them."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from lanewise.functions import geometry as G, trajectory_pairs as P

NO_MATCH = 1e5
#: Frames of a row of a trajectory; points and vehicles of a block, as many as a task holds, since each side travels as often as the other has blocks; least points of one, while there are no more than EDGE
#: blocks a side.
PART, POINTS, VEHICLES, FEW, EDGE = 1024, 3 << 18, 3 << 12, 1 << 13, 8


def build(points: DataFrame, by: list[str], clock: str | None = None) -> DataFrame:
    """A row a vehicle: first and last frame, number of points, gaps flagged, and its points in order of frame. With a clock (milliseconds a point) also start_ms and delta_ms, its mean step a frame."""
    ordered = F.sort_array(F.collect_list(F.struct("frame_index", "x", "y", "lane_id"))).alias("points")
    times = [F.min(clock).alias("start_ms"), F.max(clock).alias("_end")] if clock else []
    out = points.groupBy(*by).agg(F.min("frame_index").alias("first"), F.max("frame_index").alias("last"), F.count("*").alias("n"), ordered, *times)
    if clock:
        out = out.withColumn("delta_ms", (F.col("_end") - F.col("start_ms")) / F.nullif(F.col("last") - F.col("first"), F.lit(0))).drop("_end")
    return out.withColumn("has_gaps", F.col("last") - F.col("first") + 1 > F.col("n"))


def reindexed(frame: Column, start: Column, delta: Column, main_start: Column, main_delta: Column, main_first: Column, first: Column) -> Column:
    """A frame number of one video in the numbering of another, rounded half to even."""
    return F.bround((((frame - first) * delta + start - main_start) / main_delta + main_first).cast("double")).cast("long")


def similarity(left: DataFrame, right: DataFrame, least_frames: int = 5, lane_weight: float = 100.0, lanes: int = 50, by: list[str] | None = None) -> DataFrame:
    """by, a, b, dist of each two trajectories that share frames (left: by, a, right: by, b; frame_index, x, y, lane_id). by: the pair of videos, or none.

    Half the sum of the root sums of squared differences in x and y over the shared frames, so a longer overlap weighs more. Pairs that share
    too few frames, or that move in opposite directions, get NO_MATCH. Where lanes are known their mean difference is added. The
    join is on by and the frame, not on ranges of frames. Without by every trajectory meets all of the other side: see _in_blocks.
    """
    if not by:
        return _in_blocks(left, right, least_frames, lane_weight, lanes)
    a = left.select(*by, "a", "frame_index", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("lane_id").alias("al"))
    b = right.select(*by, "b", "frame_index", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("lane_id").alias("bl"))
    ends = [f(c, "frame_index").alias(f"{c}_{n}") for c in ("ax", "ay", "bx", "by") for n, f in (("first", F.min_by), ("last", F.max_by))]
    square = lambda p, q: F.sqrt(F.sum((F.col(p) - F.col(q)) * (F.col(p) - F.col(q))))
    per = a.join(b, [*by, "frame_index"]).groupBy(*by, "a", "b").agg(
        (F.max("frame_index") - F.min("frame_index")).alias("span"),
        ((square("ax", "bx") + square("ay", "by")) / 2).alias("gap"),
        F.avg(F.abs(F.col("al") - F.col("bl"))).alias("lane_gap"),
        F.max("al").alias("al"),
        F.max("bl").alias("bl"),
        *ends,
    )
    move = lambda s: (F.col(f"{s}_last") - F.col(f"{s}_first"))
    turned = move("ax") * move("bx") + move("ay") * move("by") < 0
    known = F.col("al").between(1, lanes - 1) | F.col("bl").between(1, lanes - 1)
    dist = F.col("gap") + F.when(known, lane_weight * F.col("lane_gap")).otherwise(0.0)
    return per.select(*by, "a", "b", F.when((F.col("span") < least_frames) | turned, NO_MATCH).otherwise(dist).alias("dist"))


def _dealt(left: DataFrame, right: DataFrame) -> DataFrame:
    """_i, _j, _left, a, b, _p: trajectories of either side, once for each block of the other."""
    def parts(side: DataFrame, key: str) -> DataFrame:
        point = F.struct(F.col("frame_index").cast("long").alias("f"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "lane_id")])
        return side.filter("frame_index IS NOT NULL").groupBy(key, F.floor(F.col("frame_index") / PART).alias("_part")).agg(F.collect_list(point).alias("_p")).drop("_part")

    def blocks(side: DataFrame, key: str, name: str) -> DataFrame:
        n = F.coalesce(F.sum(F.size("_p")), F.lit(0))
        return side.agg(F.greatest(F.lit(1), F.ceil(n / POINTS), F.ceil(F.count_distinct(key) / VEHICLES), F.least(F.lit(EDGE), F.ceil(n / FEW))).cast("int").alias(name))

    a, b = parts(left, "a"), parts(right, "b")
    sizes = F.broadcast(blocks(a, "a", "_na").crossJoin(blocks(b, "b", "_nb")))
    deal = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ra = a.crossJoin(sizes).select(deal("a", F.col("_na")).alias("_i"), each("_nb").alias("_j"), F.lit(True).alias("_left"), "a", "_p")
    rb = b.crossJoin(sizes).select(each("_na").alias("_i"), deal("b", F.col("_nb")).alias("_j"), F.lit(False).alias("_left"), "b", "_p")
    return ra.unionByName(rb, allowMissingColumns=True).select("_i", "_j", "_left", "a", "b", "_p")


def _in_blocks(left: DataFrame, right: DataFrame, least_frames: int, lane_weight: float, lanes: int) -> DataFrame:
    """a, b, dist of similarity() for all trajectories of both sides.

    Points that meet are the square of a frame's points, so they aren't shuffled: each side is dealt into blocks by vehicle, each two blocks meet in a task, and only
    points travel, as often as the other side has blocks. Within a task tiles of vehicles are added up, so a block of long trajectories needs no more than its points.
    """
    rows = _dealt(left, right)
    schema = ST.StructType([ST.StructField("a", left.schema["a"].dataType), ST.StructField("b", right.schema["b"].dataType), ST.StructField("dist", ST.DoubleType())])

    def one_side(rows: pa.Table, key: str) -> tuple[pa.Array, list[P.Points]]:
        ids = rows[key].combine_chunks().dictionary_encode("encode")
        lists = rows["_p"].combine_chunks()
        flat = lists.flatten()
        columns = [flat.field(c) for c in ("x", "y", "lane_id")]
        vehicle = np.repeat(ids.indices.to_numpy().astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False))
        there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns]) if any(c.null_count for c in columns) else None
        return ids.dictionary, P.tiles(vehicle, flat.field("f").to_numpy(), np.stack([c.to_numpy(zero_copy_only=False) for c in columns]), there, len(ids.dictionary))

    def met(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        sides = [rows.filter(m) for m in (rows["_left"], pc.invert(rows["_left"]))]
        if all(len(s) for s in sides):
            (ids_a, tiles_a), (ids_b, tiles_b) = one_side(sides[0], "a"), one_side(sides[1], "b")
            for ta in tiles_a:
                for tb in tiles_b:
                    at, bt, dist, unknown = P.distances(ta, tb, least_frames, lane_weight, lanes, NO_MATCH)
                    yield pa.RecordBatch.from_arrays([ids_a.take(pa.array(at)), ids_b.take(pa.array(bt)), pa.array(dist, mask=unknown)], ["a", "b", "dist"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            i, j = (batch.column(k).to_numpy() for k in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist(), len(i)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    if held and at != (i[lo], j[lo]):
                        yield from met(held)
                        held = []
                    at = (i[lo], j[lo])
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from met(held)

    return rows.repartition("_i", "_j").sortWithinPartitions("_i", "_j").mapInArrow(walk, schema)


def lane_smoothed(points: DataFrame, by: list[str]) -> DataFrame:
    """Every point gets its vehicle's most frequent lane (of equally frequent ones the least); vehicles without one go."""
    counts = points.groupBy(*by, "lane_id").agg(F.count("*").alias("n"))
    mode = counts.groupBy(*by).agg(F.max_by("lane_id", F.struct("n", -F.col("lane_id"))).alias("lane_mode"))
    return points.join(mode.filter("lane_mode <> -1"), by)


def fused(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters of vehicles as one trajectory each: mean place by frame, least lane, and whether its frames are without a gap.

    points: veh_id, frame_index, x, y, lane_id; clusters: veh_id, cluster.
    """
    each = points.join(clusters, "veh_id").groupBy("cluster", "frame_index").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("lane_id").alias("lane_id"))
    all_frames = Window.partitionBy("cluster")
    whole = F.max("frame_index").over(all_frames) - F.min("frame_index").over(all_frames) + 1 == F.count("*").over(all_frames)
    return each.withColumn("whole", whole)


def with_unmatched(fusions: DataFrame, points: DataFrame, clusters: DataFrame) -> DataFrame:
    """The fused trajectories and every vehicle of no cluster, as one set."""
    rest = points.join(clusters, "veh_id", "left_anti").select(F.col("veh_id").alias("id"), "frame_index", "x", "y", "lane_id", F.lit(False).alias("is_fused"))
    return fusions.select(F.col("cluster").alias("id"), "frame_index", "x", "y", "lane_id", F.lit(True).alias("is_fused")).unionByName(rest)


def cross_faded(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """Two partly overlapping trajectories as one: over the shared frames the weight moves evenly from the first to the second."""
    a = first.select(*by, "frame_index", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = second.select(*by, "frame_index", F.col("x").alias("bx"), F.col("y").alias("by"))
    both = a.join(b, [*by, "frame_index"], "full").withColumn("shared", F.col("ax").isNotNull() & F.col("bx").isNotNull())
    w = Window.partitionBy(*by, "shared")
    share = (F.row_number().over(w.orderBy("frame_index")) - 1) / F.count("*").over(w)
    mixed = lambda p, q: F.when(F.col("shared"), F.col(p) * (1 - share) + F.col(q) * share).otherwise(F.coalesce(p, q))
    return both.select(*by, "frame_index", mixed("ax", "bx").alias("x"), mixed("ay", "by").alias("y"), "shared")


def joined(main: DataFrame, sub: DataFrame, by: list[str], mixed: tuple[str, ...] = ("x", "y", "line_pos", "line_offset"), lane: str = "lane_id") -> DataFrame:
    """by, frame_index, the mixed columns, lane: two trajectories of a key as one, where they overlap in part: the earlier one begins and ends first. Other keys have no rows.

    Over the shared frames the weight moves evenly from the earlier to the later. The lane is the earlier one's up to the middle of the shared frames, and then the later one's.
    """
    names = [*mixed, lane]
    side = lambda df, p: df.select(*by, "frame_index", F.struct(*names).alias(p))
    both = side(main, "m").join(side(sub, "s"), [*by, "frame_index"], "full")
    end = lambda p, f, n: f(F.when(F.col(p).isNotNull(), F.col("frame_index"))).alias(f"{p}{n}")
    ends = both.groupBy(*by).agg(*[end(p, f, n) for p in "ms" for n, f in ((0, F.min), (1, F.max))], F.count_if(F.col("m").isNotNull() & F.col("s").isNotNull()).alias("_n"))
    first_main = (F.col("m0") < F.col("s0")) & (F.col("s0") < F.col("m1")) & (F.col("m1") < F.col("s1"))
    first_sub = (F.col("s0") < F.col("m0")) & (F.col("m0") < F.col("s1")) & (F.col("s1") < F.col("m1"))
    ends = ends.filter(first_main | first_sub).withColumn("_swap", first_sub).select(*by, "_n", "_swap")
    rows = both.join(ends, by).withColumns({"a": F.when(F.col("_swap"), F.col("s")).otherwise(F.col("m")), "b": F.when(F.col("_swap"), F.col("m")).otherwise(F.col("s"))})
    rows = rows.withColumn("_shared", F.col("a").isNotNull() & F.col("b").isNotNull())
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_shared").orderBy("frame_index")) - 1)
    share = F.col("_i") / F.col("_n")
    mix = lambda c: F.when(F.col("_shared"), F.col(f"a.{c}") * (1 - share) + F.col(f"b.{c}") * share).otherwise(F.coalesce(f"a.{c}", f"b.{c}"))
    later = F.col("_i") >= F.col("_n") - F.floor((F.col("_n") - 1) / 2)
    own = F.when(F.col("_shared"), F.when(later, F.col(f"b.{lane}")).otherwise(F.col(f"a.{lane}"))).otherwise(F.coalesce(f"a.{lane}", f"b.{lane}"))
    return rows.select(*by, "frame_index", *[mix(c).alias(c) for c in mixed], own.alias(lane))


def kept_by_ends(points: DataFrame, matched: DataFrame, reach: float = 30.0, early: int = 10) -> DataFrame:
    """Matched vehicles, and others that start early or start within reach of either end of the line. points: veh_id, frame_index, pos."""
    starts = points.groupBy("veh_id").agg(F.min("frame_index").alias("first"), F.min_by("pos", "frame_index").alias("pos"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    ends = starts.agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi")).withColumn("_k", F.lit(0))
    near = (F.col("pos") < F.col("_lo") + reach) | (F.col("pos") > F.col("_hi") - reach)
    rest = starts.withColumn("_k", F.lit(0)).join(F.broadcast(ends), "_k").filter((F.col("first") < early) | near)
    return rest.join(matched, "veh_id", "left_anti").select("veh_id").unionByName(starts.join(matched, "veh_id", "left_semi").select("veh_id"))


def line_places(points: DataFrame, line: list[tuple[float, float]], base: tuple[float, float], per_pixel: float = 1.0, base_distance: float = 0.0) -> DataFrame:
    """points with line_pos, the distance along a driving line from its base point, and line_offset, left positive."""
    on = G.project_on_known_line(F.col("x"), F.col("y"), line)
    at = G.project_on_known_line(F.lit(float(base[0])), F.lit(float(base[1])), line)
    out = points.withColumn("_on", on)
    pos, off = (F.col("_on.pos") - at.pos) * per_pixel + base_distance, F.col("_on.dist") * F.col("_on.side") * per_pixel
    return out.withColumns({"line_pos": pos, "line_offset": off}).drop("_on")


def shifted(step: DataFrame, offsets: list[int]) -> DataFrame:
    """Each row once an offset, its frame moved by it. The number of offsets is a parameter."""
    return step.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("frame_index", F.col("frame_index") + F.col("offset"))


def search_order(radius: int) -> list[int]:
    """0, 1, -1, 2, -2, ..."""
    return [0] + [s * k for k in range(1, radius + 1) for s in (1, -1)]
