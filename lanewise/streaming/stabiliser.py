"""Maps to a video's first frame, live: what operators.connection.cumulated() gives, as a stateful stream keyed by video."""
from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lanewise.functions.affine import SAME, product
from lanewise.operators.connection import is_anchor
from lanewise.streaming.states import one, until


class Anchors(StatefulProcessor):
    """State: the map of the anchor at hand and the last frame seen."""

    def __init__(self, every: int, skip: list[tuple[int, int]], idle_ms: int, names: list[str]) -> None:
        self.every, self.skip, self.idle_ms, self.names = every, skip, idle_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "anchor array<double>, last long")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.iloc[-1]
        self.at.update(([float(v) for v in row["anchor"]], int(row["last"])))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("frame_index", kind="stable")
        anchor, last = one(self.at, (list(SAME), -(2**63)))
        out = []
        for frame, step in zip(found["frame_index"].tolist(), found["map"], strict=True):
            if frame > last:  # what comes after a later frame can't be placed any more
                now = product(list(anchor), list(step))
                out.append((*key, frame, now))
                anchor, last = now if is_anchor(frame, self.every, self.skip) else anchor, frame
        self.at.update(([float(v) for v in anchor], last))
        until(self.handle, int(found["ms"].max()) + self.idle_ms)
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.at.clear()
        return iter([])

    def close(self) -> None:
        pass


def cumulated_stream(
    steps: DataFrame, video: str, every: int = 30, skip: list[tuple[int, int]] | None = None, clock: str = "unix_ms", delay: str = "10 seconds", idle_ms: int = 60_000, initial: DataFrame | None = None
) -> DataFrame:
    """video, frame_index, map of a stream of steps (video, frame_index, map to the anchor before, clock in milliseconds since 1970).

    A video's frames come in order over batches, up to the delay; within a batch they are sorted here, and those that come after a later one are left out. State goes when the watermark is idle_ms past
    a video's last frame. initial: video, anchor, last, where a batch run has ended (anchors_of()).
    """
    rows = steps.select(video, "frame_index", F.col("map").cast("array<double>").alias("map"), F.col(clock).cast("double").alias("ms"), F.timestamp_millis(F.col(clock).cast("long")).alias("at")).withWatermark("at", delay)
    out = T.StructType([T.StructField(video, steps.schema[video].dataType), *T._parse_datatype_string("frame_index long, map array<double>").fields])
    known = None if initial is None else initial.select(video, F.col("anchor").cast("array<double>").alias("anchor"), F.col("last").cast("long").alias("last")).groupBy(video)
    return rows.groupBy(video).transformWithStateInPandas(Anchors(every, list(skip or []), idle_ms, out.fieldNames()), out, "Append", "EventTime", known)


def anchors_of(maps: DataFrame, video: str, every: int = 30, skip: list[tuple[int, int]] | None = None) -> DataFrame:
    """video, anchor, last: the state in which a batch's maps (video, frame_index, map) leave each video."""
    spans = list(skip or [])
    anchors = (F.col("frame_index") % every == 0) & ~_in_any(spans)
    latest = F.max_by(F.when(anchors, F.col("map")), F.when(anchors, F.col("frame_index")))
    return maps.groupBy(video).agg(F.coalesce(latest, F.array(*[F.lit(v) for v in SAME])).alias("anchor"), F.max("frame_index").alias("last"))


def _in_any(spans: list[tuple[int, int]]) -> Any:
    from lanewise.operators.relational import in_spans

    return in_spans(F.col("frame_index"), spans)
