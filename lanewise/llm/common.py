"""What several of the operators share."""
from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.tables import dropped, written

__all__ = ["LOWER_BYTES", "WORD", "dropped", "finite", "integer_rows", "kept_by_worker", "let", "small_batches", "table", "word_count", "words", "written"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: lower-cases A-Z and leaves all other bytes of UTF-8.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, also where body names it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 4096, size: int = 4_000_000) -> Iterator[None]:
    """While it lasts, whole texts reach Python so many rows or bytes at a time, which bounds memory on both sides."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    were = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in were.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integer_rows(values: pa.BinaryArray, dim: int) -> np.ndarray:
    """Integers of two or eight bytes each as [rows, dim], in the wider of the types that the rows have."""
    held = values.to_pylist()
    kinds = {len(v) // dim for v in held} if dim else set()
    if len(kinds) > 1:
        held = [np.frombuffer(v, f"<i{len(v) // dim}").astype("<i8").tobytes() for v in held]
    return np.frombuffer(b"".join(held), f"<i{max(kinds, default=2)}").reshape(len(held), dim)


def kept_by_worker(name: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """make(), kept from task to task by the Python worker for the last key. It lies in a module of its own: a worker needs no copy of this package."""
    held = sys.modules.setdefault("kept_by_worker", types.ModuleType("kept_by_worker")).__dict__
    if held.get(name, (None,))[0] != key:
        held[name] = (key, make())
    return held[name][1]
