"""Graphs of videos and of matches. Each round is a join and an aggregate over tables; nothing stops a search before it is done."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions import affine
from lanewise.tables import dropped, written


def paths_to_root(edges: DataFrame, root: int) -> DataFrame:
    """node, depth, shift of each node that reaches the root: its shortest way, with the offsets of its edges added up.

    edges: src, dst, shift and perhaps map (six numbers, from src's plane to dst's); with it, node's map to the root is the product along
    the way. Of equally short ways the one of least shift counts, then that by the smaller neighbour. A node is visited once, so cycles do no harm;
    a round reaches the next depth.
    """
    mapped = "map" in edges.columns
    node = edges.schema["src"].dataType
    edges = edges.select("src", "dst", F.col("shift").cast("double").alias("shift"), *(["map"] if mapped else []))
    first = edges.sparkSession.range(1).select(F.lit(root).cast(node).alias("node"), F.lit(0).alias("depth"), F.lit(0.0).alias("shift"), *([affine.identity().alias("map")] if mapped else []))
    seen, depth, n = written(first, "paths"), 0, 1
    while True:
        front = seen.filter(F.col("depth") == depth).select(F.col("node").alias("dst"), F.col("shift").alias("_shift"), *([F.col("map").alias("_map")] if mapped else []))
        ways = edges.join(front, "dst").join(seen.select(F.col("node").alias("src")), "src", "left_anti")
        fields = [(F.col("shift") + F.col("_shift")).alias("shift"), F.col("dst")] + ([affine.composed(F.col("_map"), F.col("map")).alias("map")] if mapped else [])
        best = ways.groupBy(F.col("src").alias("node")).agg(F.min(F.struct(*fields)).alias("w"))
        depth += 1
        now = written(seen.unionByName(best.select("node", F.lit(depth).alias("depth"), "w.shift", *(["w.map"] if mapped else []))), "paths")
        before, n = n, now.count()
        dropped(seen)
        seen = now
        if n == before:
            return seen


def clusters(pairs: DataFrame) -> DataFrame:
    """node, cluster: connected components of pairs (a, b); a cluster is named by its least node.

    Least labels move along the edges, and labels jump to their labels' labels, until none changes.
    """
    edges = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("cluster")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("cluster").alias("c"))
        step = labels.join(near, "node").select("node", F.least("cluster", "c").alias("c"), F.col("cluster").alias("was"))
        jump = step.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        now = written(step.join(jump, "c").select("node", F.least("c", "cc").alias("cluster"), "was"), "labels")
        done = now.filter("cluster <> was").isEmpty()
        dropped(labels)
        labels = now.select("node", "cluster")
        labels._written_to = now._written_to
        if done:
            dropped(edges)
            return labels


def first_fit_clusters(pairs: DataFrame, order: str, by: str) -> DataFrame:
    """by, node, cluster_no by a single pass in order: a pair joins the first cluster that holds either of its nodes, else begins one.

    Not the transitive closure: a pair that touches two clusters leaves them apart, and a node may be in both. The pass is sequential in each block `by`.
    """
    from lanewise.operators.tracking import walked_schema, walked

    def begin() -> list[set]:
        return []

    def step(held: list[set], row: dict) -> list[tuple]:
        k = next((i for i, c in enumerate(held) if row["a"] in c or row["b"] in c), len(held))
        if k == len(held):
            held.append(set())
        new = [x for x in dict.fromkeys((row["a"], row["b"])) if x not in held[k]]
        held[k].update(new)
        return [(x, k) for x in new]

    return walked(pairs.select(by, order, "a", "b"), by, order, walked_schema(pairs, by, [("node", pairs.schema["a"].dataType.simpleString()), ("cluster_no", "int")]), begin, step)


def distances(parts: DataFrame) -> DataFrame:
    """node, distance from its chain's base, by following `next`. parts: node, next, length, is_base.

    Pointers to the part before double in each round, so a chain of n parts takes log n joins. Parts that no base leads to have no row.
    """
    bases = parts.filter("is_base").select("node")
    ways = parts.filter("next is not null").select(F.col("next").alias("node"), F.col("node").alias("up"), F.col("length").cast("double").alias("distance"))
    ways = ways.join(bases.select(F.col("node").alias("up"), F.lit(True).alias("done")), "up", "left").select("node", "up", "distance", F.coalesce("done", F.lit(False)).alias("done"))
    now, n = written(ways, "chain"), parts.count()
    for _ in range(max(1, n).bit_length()):  # enough for the longest chain; what is then open runs in a circle
        if now.filter("not done").isEmpty():
            break
        up = now.select(F.col("node").alias("up"), F.col("up").alias("upper"), F.col("distance").alias("more"), F.col("done").alias("at_base"))
        far = now.filter("not done").join(up, "up").select("node", F.col("upper").alias("up"), (F.col("distance") + F.col("more")).alias("distance"), F.col("at_base").alias("done"))
        after = written(now.filter("done").unionByName(far), "chain")
        dropped(now)
        now = after
    return bases.select("node", F.lit(0.0).alias("distance")).unionByName(now.filter("done").select("node", "distance"))
