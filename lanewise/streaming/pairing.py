"""Lock-step pairs of two live videos: a merge of two ordered streams, keyed by the pair of videos."""
from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lanewise.streaming.states import one, until

OUT = "n long, main_frame long, main_ms double, sub_frame long, sub_ms double"


class Pairs(StatefulProcessor):
    """State: the two first clocks, the last frames seen, how many frames are still to be used up, the next number; and frames of the side that is ahead."""

    def __init__(self, tolerance: float, used: int, idle_ms: int) -> None:
        self.tolerance, self.used, self.idle_ms = tolerance, used, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "main_first double, sub_first double, main_last long, sub_last long, main_use int, sub_use int, n long")
        self.waiting = {side: handle.getListState(side, "frame long, ms double") for side in ("main", "sub")}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["side", "frame"], kind="stable")
        m_first, s_first, m_last, s_last, m_use, s_use, n = one(self.at, (None, None, None, None, self.used, self.used, 0))
        first, last, use = {"main": m_first, "sub": s_first}, {"main": m_last, "sub": s_last}, {"main": m_use, "sub": s_use}
        held = {side: [(f, t) for f, t in self.waiting[side].get()] if self.waiting[side].exists() else [] for side in first}
        for side, part in found.groupby("side"):
            for frame, ms in zip(part["frame"].tolist(), part["ms"].tolist(), strict=True):
                if last[side] is None or frame > last[side]:  # a reader doesn't go back
                    first[side] = ms if first[side] is None else first[side]
                    last[side] = frame
                    held[side].append((frame, ms))
        out: list[tuple] = []
        if first["main"] is not None and first["sub"] is not None:
            together = abs(first["main"] - first["sub"]) <= self.tolerance
            for side in held:
                start = first[side] if together else max(first.values())
                held[side] = [x for x in held[side] if x[1] >= start]
                gone = min(use[side], len(held[side]))
                use[side], held[side] = use[side] - gone, held[side][gone:]
            pairs = min(len(held["main"]), len(held["sub"]))
            out = [(n + i, *held["main"][i], *held["sub"][i]) for i in range(pairs)]
            n += pairs
            held = {side: rest[pairs:] for side, rest in held.items()}
        self.at.update((first["main"], first["sub"], last["main"], last["sub"], use["main"], use["sub"], n))
        for side, rest in held.items():
            self.waiting[side].clear()
            if rest:
                self.waiting[side].put(rest)
        until(self.handle, int(found["ms"].max()) + self.idle_ms)
        yield pd.DataFrame([(*key, *x) for x in out], columns=self.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Both videos are over: nothing of them is kept."""
        self.at.clear()
        for state in self.waiting.values():
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def paired_stream(main: DataFrame, sub: DataFrame, by: str, clock: str = "unix_ms", order: str = "frame_index", tolerance: float = 0.0, used: int = 1, delay: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """by and n, main_frame, main_ms, sub_frame, sub_ms of two streams, as operators.pairing.lock_step() pairs them.

    The clock (milliseconds since 1970) is the event time of both. Frames of a side come in order over batches, up to the delay; within a batch they are sorted here, and those that come after a later one
    are left out. What is kept of a pair of videos goes when the watermark is idle_ms past its last frame.
    """
    sides = [df.select(by, F.lit(side).alias("side"), F.col(order).cast("long").alias("frame"), F.col(clock).cast("double").alias("ms")) for side, df in (("main", main), ("sub", sub))]
    rows = sides[0].unionByName(sides[1]).withColumn("at", F.timestamp_millis(F.col("ms").cast("long"))).withWatermark("at", delay)
    out = T.StructType([T.StructField(by, main.schema[by].dataType), *T._parse_datatype_string(OUT).fields])
    pairs = Pairs(tolerance, used, idle_ms)
    pairs.names = out.fieldNames()
    return rows.groupBy(by).transformWithStateInPandas(pairs, out, "Append", "EventTime")
