"""Maps between planes from pairs of points of which many may be wrong: hypotheses, a count of who agrees, and a fit to those."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import affine, geometry as G
from lanewise.operators import roads
from lanewise.operators.road_tables import MANY, salted_join

#: Pairs of points of a group whose pairings are the hypotheses: with two right ones among them some hypothesis is right. Of 16 with 40 % wrong all but one are wrong with a chance of 1e-5.
SAMPLE = 16
#: The order in which a sample is taken: key * FACTOR + SHIFT modulo a prime, so reruns agree.
FACTOR, SHIFT, PRIME = 48_271, 11, 2_147_483_647


def similarity_through(p: Column, q: Column) -> Column:
    """The turn, scale and shift that take p's (x, y) to its (u, v), and q's to its; null if p and q are one point."""
    dx, dy, du, dv = q.x - p.x, q.y - p.y, q.u - p.u, q.v - p.v
    size = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    turn = F.struct(((dx * du + dy * dv) / size).alias("c"), ((dx * dv - dy * du) / size).alias("s"))
    return G.let(turn, lambda t: F.when(t.c.isNotNull(), F.array(t.c, -t.s, p.u - t.c * p.x + t.s * p.y, t.s, t.c, p.v - t.s * p.x - t.c * p.y)))


def squared_error(m: Column, x: Column, y: Column, u: Column, v: Column) -> Column:
    a, b = affine.applied(m, x, y)
    return (a - u) * (a - u) + (b - v) * (b - v)


def hypotheses(pairs: DataFrame, by: list[str], key: str, sample: int = SAMPLE) -> DataFrame:
    """by, maps: one for each two of the first `sample` pairs of a group in the order of their keys' hash. The rank filter drops rows before they are shuffled."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.pmod(F.col(key) * FACTOR + SHIFT, F.lit(PRIME)), key, "x", "y", "u", "v"))
    few = pairs.select(*by, key, "x", "y", "u", "v").withColumn("_n", place).filter(F.col("_n") <= sample)
    held = few.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("_n").alias("n"), "x", "y", "u", "v"))).alias("_p"))
    with_later = lambda p, i: F.transform(F.slice("_p", i + 2, F.lit(sample)), lambda q: similarity_through(p, q))
    return held.select(*by, F.array_compact(F.flatten(F.transform("_p", with_later))).alias("maps"))


def _refit(pairs: DataFrame, maps: DataFrame, by: list[str], tolerance: float, many: int) -> DataFrame:
    """by, map, inliers: the least-squares similarity of the pairs that agree with maps."""
    near = salted_join(pairs, maps, by, many).filter(squared_error(F.col("map"), F.col("x"), F.col("y"), F.col("u"), F.col("v")) <= tolerance * tolerance)
    return near.groupBy(*by).agg(affine.similarity_fit(F.col("x"), F.col("y"), F.col("u"), F.col("v")).alias("map"), F.count("*").alias("inliers"))


def robust_fits(pairs: DataFrame, by: list[str], key: str, tolerance: float = 3.0, sample: int = SAMPLE, rounds: int = 2, many: int = MANY) -> DataFrame:
    """by, map, inliers: the turn, scale and shift on which most pairs (by, key, x, y, u, v) of a group agree within the tolerance, fitted to those.

    All groups are scored at once: each pair meets its group's hypotheses, and one count by group and hypothesis, added up before it is shuffled, tells which has most company (of equal ones the first).
    The fit is repeated with those that agree with it. Groups whose points don't differ have no row; a group that holds most of the pairs is split.
    """
    pairs = pairs.select(*by, key, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "u", "v")]).dropna()
    maps = hypotheses(pairs, by, key, sample)
    each = salted_join(pairs, maps, by, many).select(*by, "x", "y", "u", "v", F.posexplode("maps").alias("h", "map"))
    agrees = squared_error(F.col("map"), F.col("x"), F.col("y"), F.col("u"), F.col("v")) <= tolerance * tolerance
    votes = each.filter(agrees).groupBy(*by, "h").count()
    best = votes.groupBy(*by).agg(F.max_by("h", F.struct("count", -F.col("h"))).alias("h"))
    now = maps.join(best, by).select(*by, F.get("maps", F.col("h")).alias("map"))
    for _ in range(rounds):
        now = _refit(pairs, now.select(*by, "map"), by, tolerance, many)
    return now.filter("map is not null")


def calibrated_maps(main: DataFrame, sub: DataFrame, by: list[str], prefix: str, first_three: bool = False, tolerance: float = 3.0) -> DataFrame:
    """by, map (from sub's plane to main's), split_x (the largest x of main's points): from the points of the first shape of each whose label begins with prefix.

    Points are paired by their order. Three pairs, and with first_three the first three of more, give the affine map that takes each to its partner; more give the similarity on which most agree. Fewer give none.
    """
    both = roads.calibration_points(sub, by, prefix).withColumnRenamed("points", "_s").join(roads.calibration_points(main, by, prefix).withColumnRenamed("points", "_m"), by)
    both = both.filter((F.size("_m") >= 3) & (F.size("_s") >= 3)).withColumn("split_x", F.array_max(F.transform("_m", lambda p: p.x)))
    three = F.lit(True) if first_three else F.least(F.size("_m"), F.size("_s")) == 3
    corners = lambda c: [(F.get(c, F.lit(i)).x, F.get(c, F.lit(i)).y) for i in range(3)]
    exact = both.filter(three).select(*by, F.array(*G.solve_affine(corners("_s"), corners("_m"))).alias("map"), "split_x").filter(F.get("map", F.lit(0)).isNotNull())
    pairs = both.filter(~three).select(*by, F.posexplode(F.arrays_zip("_s", "_m")).alias("n", "p")).filter("p._s is not null and p._m is not null")
    fits = robust_fits(pairs.select(*by, "n", F.col("p._s.x").alias("x"), F.col("p._s.y").alias("y"), F.col("p._m.x").alias("u"), F.col("p._m.y").alias("v")), by, "n", tolerance)
    return exact.unionByName(fits.join(both, by).select(*by, "map", "split_x"))
