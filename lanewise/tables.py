"""Tables that end a lineage, in the folder that all executors share.

Steps delete theirs once nothing reads them any more. Those that a result still reads stay as long as it does: whoever has used the result calls clear(), or gives a folder of
their own with work_folder() and deletes that.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables of this driver that are still there, and the folders that callers have named, innermost last.
_THERE: list[str] = []
_FOLDERS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that work_folder() names, else the one that the cluster names in spark.checkpoint.dir; one in the warehouse, which is shared too, where both are unset.

    A cluster whose warehouse is on the machines' own disks has to set spark.checkpoint.dir.
    """
    if _FOLDERS:
        return _FOLDERS[-1]
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lanewise-steps").rstrip("/")


@contextmanager
def work_folder(path: str) -> Iterator[str]:
    """Tables that are written meanwhile lie in this folder, which is the caller's to delete."""
    _FOLDERS.append(path.rstrip("/"))
    try:
        yield path
    finally:
        _FOLDERS.pop()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own: lineage ends there, and the loss of an executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/lanewise-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    _THERE.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _THERE:
        _THERE.remove(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it any more."""
    for df in tables:
        _delete(df.sparkSession, df._written_to)


def clear(spark: SparkSession) -> int:
    """Deletes all tables of written() that are still there, and tells how many. Results that read them can't be read any more."""
    paths = list(_THERE)
    for path in paths:
        _delete(spark, path)
    return len(paths)
