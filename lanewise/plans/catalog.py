"""All queries of the engine by name, with the SQL that they equal."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lanewise.plans import connect, consensus, frames, heads, motion, road_tables, roads, scene, tracks, videos

GROUPS = (scene, connect, consensus, frames, heads, motion, roads, road_tables, tracks, videos)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for group in GROUPS for name, (query, _) in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, (_, sql) in group.QUERIES.items() if sql}
