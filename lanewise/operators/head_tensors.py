"""Detections from a network's output tensors: levels unfolded to cells, grid heads and centre heads decoded, back to the image's own pixels."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lanewise.functions import heads
from lanewise.operators import relational as R

#: Cells that leave a task at a time.
CELLS = 4096
#: Under this the four vectors don't hold, and the box is upright.
TURNED = 0.8


def folded(rows: DataFrame, by: list[str], values: str = "values") -> DataFrame:
    """by and data: an array of numbers, channel by channel and row by row, as 32-bit floats in one binary, which is what a network writes."""
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("data", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.asarray(v, "<f4").tobytes() for v in batch.column(len(by)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(data, pa.binary())], [*by, "data"])

    return rows.select(*by, values).mapInArrow(pack, schema)


def unfolded(levels: DataFrame, image: str = "image_id") -> DataFrame:
    """image, level, cell, cell_x, cell_y, values: a row a cell with the numbers of its channels. levels: image, level, height, width, data (from folded(); channels follow from its size)."""
    schema = T.StructType([levels.schema[image], *T._parse_datatype_string("level int, cell int, cell_x int, cell_y int, values array<float>").fields])
    kind = to_arrow_type(levels.schema[image].dataType)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, level, height, width, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                tensor = np.frombuffer(data, "<f4").reshape(-1, height * width).T
                for lo in range(0, len(tensor), CELLS):
                    part = np.ascontiguousarray(tensor[lo : lo + CELLS])
                    n, cell = len(part), np.arange(lo, lo + len(part), dtype="<i4")
                    values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="<i4") * part.shape[1]), pa.array(part.ravel()))
                    places = [pa.array(c) for c in (np.full(n, level, "<i4"), cell, cell % width, cell // width)]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n, kind), *places, values], schema.fieldNames())

    return levels.select(image, F.col("level").cast("int"), F.col("height").cast("int"), F.col("width").cast("int"), "data").mapInArrow(unpack, schema)


def grid_detections(levels: DataFrame, input_height: int, vectors_at: int = 6, least: float = 0.5, image: str = "image_id") -> DataFrame:
    """image, level, cell, cx, cy, w, h, x1, y1 .. x4, y4, score, category of cells at or over the score, in the network's pixels.

    Channels: offsets and logarithms of sides, then from vectors_at on four vectors (to the top, right, bottom and left side), the logit of turning, that of an object, and those of the classes: 6 for heads
    with two more sides, 4 for older ones. A level's stride is the input's height by its own. Corners run from the top left over the top right.
    """
    cells = unfolded(levels, image).join(F.broadcast(levels.select("level", (F.lit(float(input_height)) / F.col("height")).alias("stride")).distinct()), "level")
    at = lambda i: F.get("values", F.lit(i)).cast("double")
    kinds = F.transform(F.slice("values", F.lit(vectors_at + 11), F.greatest(F.size("values") - vectors_at - 10, F.lit(0))), lambda c: heads.logistic(c.cast("double")))
    cells = cells.withColumns({"thing": heads.logistic(at(vectors_at + 9)), "turned": heads.logistic(at(vectors_at + 8)), "kinds": kinds}).withColumn("kind", F.array_max("kinds"))
    cells = cells.withColumn("score", F.col("thing") * F.col("kind")).filter(F.col("score") >= least)
    s = F.col("stride")
    cells = cells.withColumns({"cx": (at(0) + F.col("cell_x")) * s, "cy": (at(1) + F.col("cell_y")) * s, "w": F.exp(at(2)) * s, "h": F.exp(at(3)) * s, "category": (F.array_position("kinds", F.col("kind")) - 1).cast("int")})
    vector = lambda k: (at(vectors_at + 2 * k) * s, at(vectors_at + 2 * k + 1) * s)
    top, right, bottom, left = (vector(k) for k in range(4))
    out = {}
    for k, (p, q, sx, sy) in enumerate(((top, left, -1, -1), (top, right, 1, -1), (bottom, right, 1, 1), (bottom, left, -1, 1)), 1):
        for name, own, i, side, sign in (("x", "cx", 0, "w", sx), ("y", "cy", 1, "h", sy)):
            out[f"{name}{k}"] = F.when(F.col("turned") < TURNED, F.col(own) + sign * F.col(side) / 2).otherwise(F.col(own) + p[i] + q[i])
    return cells.withColumns(out).select(image, "level", "cell", "cx", "cy", "w", "h", *out, "score", "category")


def in_image(detections: DataFrame, images: DataFrame, input_width: int, input_height: int, image: str = "image_id") -> DataFrame:
    """detections with places and sides in the pixels of their image, which lay centred in the network's input. images: image, width, height."""
    both = detections.join(images.select(image, F.col("width").alias("_w"), F.col("height").alias("_h")), image)
    fit = F.least(F.lit(float(input_width)) / F.col("_w"), F.lit(float(input_height)) / F.col("_h"))
    both = both.withColumns({"_nw": F.bround(F.col("_w") * fit), "_nh": F.bround(F.col("_h") * fit)})
    x = lambda c: (F.col(c) - (input_width - F.col("_nw")) / 2) * F.col("_w") / F.col("_nw")
    y = lambda c: (F.col(c) - (input_height - F.col("_nh")) / 2) * F.col("_h") / F.col("_nh")
    places = {c: x(c) for c in ("cx", "x1", "x2", "x3", "x4")} | {c: y(c) for c in ("cy", "y1", "y2", "y3", "y4")}
    sides = {"w": F.col("w") * F.col("_w") / F.col("_nw"), "h": F.col("h") * F.col("_h") / F.col("_nh")}
    return both.withColumns(places | sides).drop("_w", "_h", "_nw", "_nh")


def centre_detections(heat: DataFrame, outputs: DataFrame, k: int, least: float, scale: tuple[float, float] = (4.0, 4.0), image: str = "image_id") -> DataFrame:
    """image, cell, category, score and the columns of heads.centre_head() of the k strongest peaks of each image, at over `least`.

    heat: levels of one tensor an image, a channel a class, values from 0 to 1; outputs: the same of 13 channels (ten of sides, two of the centre's offset, one of turning). Peaks are the greatest of their 3 x 3
    surroundings; the k best of each class come first, then the k best over all. What the outputs hold at a peak is fetched by an equi-join on image and cell.
    """
    cells = unfolded(heat, image).select(image, "cell", F.col("cell_y").alias("y"), F.col("cell_x").alias("x"), F.posexplode("values").alias("category", "v"))
    tops = R.peaks(cells.select(image, "category", "y", "x", "v"), [image, "category"])
    width = heat.select(image, F.col("width").cast("int").alias("_width"))
    tops = tops.join(width, image).withColumn("cell", F.col("y") * F.col("_width") + F.col("x")).drop("_width").filter(F.col("v") > least)
    best = R.top_over_classes(tops, [image], "category", "v", k, ["category", "cell"])
    both = best.join(unfolded(outputs, image).select(image, "cell", "values"), [image, "cell"])
    at = [F.get("values", F.lit(i)).cast("double") for i in range(13)]
    made = heads.centre_head(F.col("x") + at[10], F.col("y") + at[11], at[:10], at[12], F.lit(scale[0]), F.lit(scale[1]))
    return both.select(image, "cell", "category", F.col("v").cast("double").alias("score"), *[c.alias(n) for n, c in made.items()])
