"""Live tracking: the batch tracker's step as a stateful stream keyed by video."""
from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lanewise.operators.tracking import TRACKERS
from lanewise.streaming.states import one, until

TRACK = "hits int, streak int, missed int, det_id int, confirmed boolean, value array<double>, speed array<double>, p array<double>, c array<double>, v array<double>"


class Tracker(StatefulProcessor):
    """State: counters and the last frame as a value; tracks as a map by id, of which what has changed is written and what has gone removed; galleries as a map by track and number, so that
    a new feature is one entry, whatever the gallery holds. Features of tracks not yet confirmed have negative numbers."""

    def __init__(self, method: str, settings: dict, names: list[str], idle_ms: int) -> None:
        self.method, self.settings, self.names, self.idle_ms = TRACKERS[method], settings, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "frames long, next_id long, last long")
        self.tracks = handle.getMapState("tracks", "id long", TRACK)
        self.features = handle.getMapState("features", "id long, n long", "feature array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        frames, next_id, last = one(self.at, (0, 1, -(2**63)))
        before = {int(k[0]): tuple(v) for k, v in self.tracks.iterator()} if self.tracks.exists() else {}
        held = {(int(k[0]), int(k[1])): v[0] for k, v in self.features.iterator()} if self.features.exists() else {}
        tracker = self.method(**self.settings).with_state((frames, next_id), before)
        self._fill(tracker, held)
        late = found["frame_index"] <= last
        out = []
        for frame, part in found[~late].sort_values(["frame_index", "score", "det_id"], ascending=[True, False, True]).groupby("frame_index", sort=True):
            features = np.array(part["feature"].tolist()) if part["feature"].notna().all() else None
            out += [(*key, frame, t, d, *box) for t, d, box in tracker.step(part["det_id"].to_numpy(), part[list(tracker.columns)].to_numpy(float), features)]
            last = int(frame)
        after = tracker.track_rows()
        for i in before.keys() - after.keys():
            self.tracks.removeKey((i,))
        for i, row in after.items():
            if row != before.get(i):
                self.tracks.updateValue((i,), row)
        now = self._numbered(tracker)
        for place in held.keys() - now.keys():
            self.features.removeKey(place)
        for place in now.keys() - held.keys():
            self.features.updateValue(place, ([float(x) for x in now[place]],))
        self.at.update((*tracker.counters(), last))
        if self.idle_ms:
            until(self.handle, int(found["ms"].max()) + self.idle_ms)
        yield pd.DataFrame(out, columns=self.names)

    @staticmethod
    def _fill(tracker: Any, held: dict[tuple[int, int], list[float]]) -> None:
        for t in getattr(tracker, "tracks", []):
            own = sorted(n for i, n in held if i == t.id)
            if own:
                t.gallery, t.fresh = ([np.array(held[t.id, n]) for n in own if (n >= 0) == kept] for kept in (True, False))
                t.seen = own[-1] + 1 if own[-1] >= 0 else 0

    @staticmethod
    def _numbered(tracker: Any) -> dict[tuple[int, int], np.ndarray]:
        out = {}
        for t in getattr(tracker, "tracks", []):
            gallery, fresh = getattr(t, "gallery", []), getattr(t, "fresh", [])
            out |= {(t.id, t.seen - len(gallery) + k): f for k, f in enumerate(gallery)}
            out |= {(t.id, k - 1_000_000): f for k, f in enumerate(fresh)}
        return out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """The video is over: a later frame of its name begins anew."""
        for state in (self.at, self.tracks, self.features):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def track_stream(boxes: DataFrame, video: str = "video_id", method: str = "sort", feature: str | None = None, clock: str | None = None, delay: str = "10 seconds", idle_ms: int = 0, **settings) -> DataFrame:
    """Tracked boxes of a stream of boxes. Frames of a video arrive in order, each whole in one batch; within a batch they are sorted here.

    A video's tracks are its state, with the last frame it has seen: frames that come later than a later one are left out, as the tracker can't go back. clock (milliseconds since 1970) is the event time;
    with it and idle_ms, what is kept of a video goes when the watermark is so long past its last frame. Call states.use_rocksdb() before the stream starts.
    """
    if idle_ms and not clock:
        raise ValueError("idle videos are told by a clock")
    shown = TRACKERS[method]()
    out = T.StructType([T.StructField(video, boxes.schema[video].dataType), *T._parse_datatype_string(shown.out).fields])
    ms = F.col(clock).cast("double") if clock else F.lit(0.0)
    appearance = F.col(feature).cast("array<double>") if feature else F.lit(None).cast("array<double>")
    rows = boxes.select(video, "frame_index", "det_id", "score", *shown.columns, appearance.alias("feature"), ms.alias("ms"))
    if clock:
        rows = rows.withColumn("at", F.timestamp_millis(F.col("ms").cast("long"))).withWatermark("at", delay)
    return rows.groupBy(video).transformWithStateInPandas(Tracker(method, settings, out.fieldNames(), idle_ms), out, "Append", "EventTime" if clock else "None")
