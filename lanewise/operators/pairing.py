"""Two videos read in lock-step: the point from which they run together, and pairs of frames from there on."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task counts.
BLOCK = 100_000


def ranked(rows: DataFrame, by: list[str], order: str, name: str = "n", block: int = BLOCK) -> DataFrame:
    """rows with their number, from 0, among those of their key in a numeric order. Keys are counted block of the order by block, so a long video is many tasks; order has no ties."""
    cut = rows.withColumn("_block", F.floor(F.col(order) / block))
    counts = cut.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(order)) - 1
    return cut.withColumn("_inside", inside).join(counts, [*by, "_block"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_block", "_inside", "_before")


def starts(main: DataFrame, sub: DataFrame, by: list[str], clock: str, tolerance: Column | float) -> DataFrame:
    """by, main_start, sub_start: clock times from which the two run together.

    If their first frames are no further apart than the tolerance they start with those; otherwise the one that begins earlier is moved on to its first frame that is not before the other's first.
    Keys without frames on a side have no row.
    """
    first = main.groupBy(*by).agg(F.min(clock).alias("_m")).join(sub.groupBy(*by).agg(F.min(clock).alias("_s")), by)
    together, late = F.abs(F.col("_m") - F.col("_s")) <= tolerance, F.greatest("_m", "_s")
    return first.select(*by, F.when(together, F.col("_m")).otherwise(late).alias("main_start"), F.when(together, F.col("_s")).otherwise(late).alias("sub_start"))


def lock_step(main: DataFrame, sub: DataFrame, by: list[str], clock: str = "unix_ms", order: str = "frame_index", tolerance: Column | float = 0.0, used: int = 1) -> DataFrame:
    """by, n, and order and clock of each side (main_*, sub_*): frames paired by their number after the start, whatever their rates and gaps; it ends with the shorter video.

    used: frames that finding the start takes from either side, as a reader that compares clocks does. Clocks don't fall along a video.
    """
    begin = starts(main, sub, by, clock, tolerance)
    both = []
    for side, rows in (("main", main), ("sub", sub)):
        late = rows.select(*by, order, clock).join(begin.select(*by, F.col(f"{side}_start").alias("_start")), by).filter(F.col(clock) >= F.col("_start")).drop("_start")
        numbered = ranked(late, by, order).filter(F.col("n") >= used).withColumn("n", F.col("n") - used)
        both.append(numbered.select(*by, "n", F.col(order).alias(f"{side}_{order}"), F.col(clock).alias(f"{side}_{clock}")))
    return both[0].join(both[1], [*by, "n"])
