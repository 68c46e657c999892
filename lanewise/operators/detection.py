"""Detectors and feature extractors as plug-ins: functions over batches of frames or crops, chosen by name; Spark deals the batches."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

DETECTIONS = "video_id string, frame_index long, det_id int, score double, category int, cx double, cy double, w double, h double, theta double"
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: By name: a function over batches of frames that gives batches of DETECTIONS. It loads its model once a task.
DETECTORS: dict[str, Batches] = {}
#: By name: a function over batches of crops that gives their columns and `feature`, an array.
EXTRACTORS: dict[str, Batches] = {}


def detector(name: str) -> Callable[[Batches], Batches]:
    """Registers the function that it decorates."""

    def keep(function: Batches) -> Batches:
        DETECTORS[name] = function
        return function

    return keep


def detect(frames: DataFrame, method: str, schema: str = DETECTIONS) -> DataFrame:
    return frames.mapInArrow(DETECTORS[method], schema)


def with_features(crops: DataFrame, method: str) -> DataFrame:
    """crops with `feature`, as trackers by appearance take it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in crops.schema.fields)
    return crops.mapInArrow(EXTRACTORS[method], f"{columns}, feature array<double>")
