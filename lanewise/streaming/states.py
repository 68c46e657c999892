"""What the stateful operators share. Their state is typed values, lists and maps of the key, in RocksDB."""
from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of several variables and timers needs this store; call it before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def one(state: Any, default: tuple) -> tuple:
    """A value state's value, or the default."""
    return tuple(state.get()) if state.exists() else default


def until(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """The key's one timer, at this event time; earlier ones go."""
    for old in list(handle.listTimers()):
        if old < at_ms:
            handle.deleteTimer(old)
    handle.registerTimer(at_ms)
