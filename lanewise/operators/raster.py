"""Images as tables of pixels (y, x, v): tiles, masks, warps, panoramas, backgrounds. Pixels move by keys, never as whole images through one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import affine, geometry as G


def tile_plan(images: DataFrame, width: int, height: int, gap: int) -> DataFrame:
    """images (with width, height) with left_px, up_px, a row a tile: steps of size less gap, the last moved to the border."""

    def starts(side: str, size: int) -> Column:
        n = F.greatest(F.lit(0), F.ceil((F.col(side) - size) / (size - gap))).cast("int")
        return F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.greatest(F.lit(0), F.least(i * (size - gap), F.col(side) - size))))

    return images.withColumn("left_px", F.explode(starts("width", width))).withColumn("up_px", F.explode(starts("height", height)))


def retiled(items: DataFrame, tiles: DataFrame, by: list[str], width: int, height: int, border: int = 0) -> DataFrame:
    """items (by, l, t, r, b) in each tile of their key that holds them whole, further from its border than `border`: tile_x, tile_y are the tile's own.

    tiles: by, tile_id, left_px, up_px, planned once a video (from its first frame) and the same for all its frames.
    """
    both = items.join(tiles, by)
    kept = (F.col("l") - F.col("left_px") > border) & (F.col("t") - F.col("up_px") > border) & (F.col("r") - F.col("left_px") < width - border) & (F.col("b") - F.col("up_px") < height - border)
    return both.filter(kept).withColumns({"tile_x": (F.col("l") + F.col("r")) / 2 - F.col("left_px"), "tile_y": (F.col("t") + F.col("b")) / 2 - F.col("up_px")})


def framed(detections: DataFrame, tiles: DataFrame, by: list[str], width: int, height: int, border: int = 0) -> DataFrame:
    """detections (by, tile_id, l, t, r, b, in their tile's pixels) in the pixels of the frame: those further from the tile's border than `border`, moved by the tile's place.

    The way back from tiles that a detector saw one by one; tiles as for retiled(), an equi-join on by and tile_id.
    """
    far = (F.col("l") > border) & (F.col("t") > border) & (F.col("r") < width - border) & (F.col("b") < height - border)
    both = detections.filter(far).join(tiles.select(*by, "tile_id", "left_px", "up_px"), [*by, "tile_id"])
    moved = {c: F.col(c) + F.col("left_px" if c in "lr" else "up_px") for c in "ltrb"}
    return both.withColumns(moved).drop("left_px", "up_px")


def lit_tiles(pixels: DataFrame, tiles: DataFrame, by: list[str], width: int, height: int, most: float = 0.98) -> DataFrame:
    """Tiles whose share of black pixels is at most `most`."""
    inside = F.col("x").between(F.col("left_px"), F.col("left_px") + width - 1) & F.col("y").between(F.col("up_px"), F.col("up_px") + height - 1)
    held = pixels.join(tiles, by).filter(inside)
    return held.groupBy(*by, "tile_id", "left_px", "up_px").agg(F.avg((F.col("v") == 0).cast("int")).alias("black")).filter(F.col("black") <= most)


def masked(pixels: DataFrame, rings: Column) -> DataFrame:
    """pixels whose place is in any of the polygons, whose vertices are truncated to integers; places on an edge are inside.

    rings: array of arrays of points. The test is per pixel, so no mask image is made.
    """
    return pixels.filter(in_mask(F.col("x"), F.col("y"), rings))


def in_mask(x: Column, y: Column, rings: Column) -> Column:
    whole = F.transform(rings, lambda ring: F.transform(ring, lambda p: G.point(p.x.cast("int"), p.y.cast("int"))))
    return F.exists(whole, lambda ring: G.inside(x, y, ring) | G.on_boundary(x, y, ring))


def shared_region(points: DataFrame, main: Column, sub: Column, to_main: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Points in the main video's region whose place in the sub video is in its region. to_main: the map from sub to main."""
    back = affine.applied(affine.inverse(to_main), F.col(x), F.col(y))
    return points.filter(G.inside(F.col(x), F.col(y), main) & G.inside(*back, sub))


def warped(pixels: DataFrame, sizes: DataFrame, maps: DataFrame, by: list[str]) -> DataFrame:
    """by, y, x, v of each image through its map, by the nearest pixel of the source; places without one are left out.

    sizes: by, width, height of the results; maps: by, map (six numbers, from source to result). Each result pixel looks up its source: an equi-join on places.
    """
    places = sizes.join(maps, by).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    sx, sy = affine.applied(affine.inverse(F.col("map")), F.col("x").cast("double"), F.col("y").cast("double"))
    near = lambda c: F.floor(c + 0.5).cast("int")
    asked = places.select(*by, "y", "x", near(sx).alias("_x"), near(sy).alias("_y"))
    return asked.join(pixels.select(*by, F.col("y").alias("_y"), F.col("x").alias("_x"), "v"), [*by, "_y", "_x"]).select(*by, "y", "x", "v")


def warped_smoothly(pixels: DataFrame, sizes: DataFrame, maps: DataFrame, by: list[str], border: float = 0.0) -> DataFrame:
    """by, y, x, v of each image through its map: each place of the result mixes the four pixels around its source by their nearness. Pixels that aren't there count as the border.

    sizes and maps as for warped(). A cell is what lies between four pixels: each pixel is sent to the four cells that it is a corner of, each place to the one that holds its source, and they meet in one shuffle.
    """
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    given = pixels.select(*by, "y", "x", F.col("v").cast("double").alias("v"), corners.alias("c"))
    given = given.select(*by, (F.col("y") - F.col("c.i")).cast("long").alias("_y"), (F.col("x") - F.col("c.j")).cast("long").alias("_x"), (F.col("c.i") * 2 + F.col("c.j")).alias("_corner"), "v")
    places = sizes.join(maps, by).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    sx, sy = affine.applied(affine.inverse(F.col("map")), F.col("x").cast("double"), F.col("y").cast("double"))
    asked = places.select(*by, "y", "x", sx.alias("sx"), sy.alias("sy"))
    asked = asked.select(*by, F.floor("sy").alias("_y"), F.floor("sx").alias("_x"), F.struct("y", "x", (F.col("sy") - F.floor("sy")).alias("fy"), (F.col("sx") - F.floor("sx")).alias("fx")).alias("_place"))
    meet = given.unionByName(asked, allowMissingColumns=True).groupBy(*by, "_y", "_x")
    cells = meet.agg(*[F.coalesce(F.max(F.when(F.col("_corner") == k, F.col("v"))), F.lit(border)).alias(f"_v{k}") for k in range(4)], F.collect_list("_place").alias("_places"))
    out = cells.select(*by, *[f"_v{k}" for k in range(4)], F.explode("_places").alias("p"))
    top = F.col("_v0") * (1 - F.col("p.fx")) + F.col("_v1") * F.col("p.fx")
    low = F.col("_v2") * (1 - F.col("p.fx")) + F.col("_v3") * F.col("p.fx")
    return out.select(*by, "p.y", "p.x", (top * (1 - F.col("p.fy")) + low * F.col("p.fy")).alias("v"))


def panorama(pixels: DataFrame, by: list[str]) -> DataFrame:
    """by, y, x, v: the brightest of each place over a scene's images, cut to the extent of what isn't black, its top left kept."""
    merged = pixels.groupBy(*by, "y", "x").agg(F.max("v").alias("v"))
    lit = lambda c: F.max(F.when(F.col("v") > 0, F.col(c)))
    extent = merged.groupBy(*by).agg(lit("y").alias("_y"), lit("x").alias("_x"))
    return merged.join(extent, by).filter((F.col("y") <= F.col("_y")) & (F.col("x") <= F.col("_x"))).drop("_y", "_x")


def background(pixels: DataFrame, frames: DataFrame, by: list[str], order: str, n: int = 50) -> DataFrame:
    """by, y, x, mean over the first n frames of each key; pixels of other frames are dropped by a join before they are summed. frames: by, order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    first = frames.select(*by, order).distinct().withColumn("_n", place).filter(F.col("_n") <= n).drop("_n")
    return pixels.join(first, [*by, order], "left_semi").groupBy(*by, "y", "x").agg(F.avg("v").alias("mean"))


def background_stream(pixels: DataFrame, by: list[str], order: str, n: int = 50) -> DataFrame:
    """The same on a stream of pixels whose frames count from 0: sums and counts are the state, and frames from n on don't reach it."""
    return pixels.filter(F.col(order) < n).groupBy(*by, "y", "x").agg(F.avg("v").alias("mean"), F.count("*").alias("frames"))


def lit_bounds(pixels: DataFrame, by: list[str]) -> DataFrame:
    """by, left, top, right, bottom of the pixels that aren't black, and their share of black."""
    lit = lambda c: F.when(F.col("v") > 0, F.col(c))
    ends = [f(lit(c)).alias(n) for n, f, c in (("left", F.min, "x"), ("right", F.max, "x"), ("top", F.min, "y"), ("bottom", F.max, "y"))]
    return pixels.groupBy(*by).agg(F.avg((F.col("v") == 0).cast("int")).alias("black"), *ends)
