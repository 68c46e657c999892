"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join.

After each round the edges are a table in the shared folder, so lineage stays short. No step gathers the neighbours of
a vertex: a hub with millions of edges is a partial minimum and a join that adaptive execution may split.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import dropped, written


def connected(edges: DataFrame) -> DataFrame:
    """edges: a, b. Gives node, component (the least node reachable), for nodes that have an edge to another."""
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = written(edges.filter("a <> b").select(high, low).distinct(), "edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    seen = now.agg(mark).first()[0]
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, written(others.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(before)
        was, seen = seen, now.agg(mark).first()[0]
        if was == seen:
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            found = written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
            dropped(now)
            return found
