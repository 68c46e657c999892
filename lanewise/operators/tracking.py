"""Multi-object tracking by detection: a fold over the frames of each video, videos in parallel.

Within a video the frames follow one another by definition. An aggregate makes one row a frame, with its boxes as arrays; rows are dealt by
video and sorted by frame, and a task walks over them with nothing held but the tracker of the video at hand. A long video is so a stream of
narrow rows. Where a tracker can take many videos a frame further at a time, a task holds some HELD frames and walks over their videos side by side. The same step drives the batch fold and the stream. Trackers are chosen by name from TRACKERS, which callers may extend.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lanewise.functions.assignment import assign, box_iou, figures_iou
from lanewise.functions.distances import METRICS
from lanewise.functions.kalman import BoxFilter, HeightFilter, TurnFilter, corners_of, first, to_box, to_state, to_turned_state

Filter = BoxFilter | HeightFilter | TurnFilter
TRACKED = "frame_index long, track_id long, det_id int, l double, t double, r double, b double"
TURNED = "frame_index long, track_id long, det_id int, cx double, cy double, w double, h double, theta double"
#: 95 % points of the chi-square distribution for two and four degrees of freedom.
GATE = {2: 5.9915, 4: 9.4877}
NEVER = 1e5
#: Frames whose videos go on side by side, and so many videos that each goes on alone, which is faster then.
HELD, NARROW = 1 << 16, 2


@dataclass
class Track:
    id: int
    filter: BoxFilter
    hits: int = 0
    streak: int = 0
    missed: int = 0
    det_id: int = -1


@dataclass
class Sort:
    """Tracks of one video. A track is reported while it is matched and has been `min_hits` times in a row, or at the video's beginning."""

    max_age: int = 30
    min_hits: int = 3
    least_iou: float = 0.3
    frames: int = 0
    next_id: int = 1
    tracks: list[Track] = field(default_factory=list)

    #: The columns of a box, in order, and of the result.
    columns = ("l", "t", "r", "b")
    out = TRACKED

    def step(self, ids: np.ndarray, boxes: np.ndarray, features: np.ndarray | None = None) -> list[tuple[int, int, np.ndarray]]:
        """(track id, detection id, box) of the tracks reported at this frame, newest first. boxes: best score first."""
        self.frames += 1
        for t in self.tracks:
            if t.missed > 0:
                t.streak = 0
            t.filter.predict()
            t.missed += 1
        expected = np.array([self.shown(t) for t in self.tracks]).reshape(-1, len(self.columns))
        fine = np.isfinite(expected).all(1)
        self.tracks, expected = [t for t, ok in zip(self.tracks, fine, strict=True) if ok], expected[fine]
        pairs = self.match(boxes, expected)
        for d, k in pairs:
            t = self.tracks[k]
            t.filter.update(self.state(boxes[d], t))
            t.missed, t.hits, t.streak, t.det_id = 0, t.hits + 1, t.streak + 1, int(ids[d])
        for d in sorted({*range(len(boxes))} - {d for d, _ in pairs}):
            self.tracks.append(Track(self.next_id, BoxFilter(self.state(boxes[d])), det_id=int(ids[d])))
            self.next_id += 1
        out = [(t.id, t.det_id, self.shown(t)) for t in reversed(self.tracks) if t.missed < 1 and (t.streak >= self.min_hits or self.frames <= self.min_hits)]
        self.tracks = [t for t in self.tracks if t.missed <= self.max_age]
        return out

    def state(self, box: np.ndarray, track: Track | None = None) -> np.ndarray:
        return to_state(box)

    def shown(self, track: Track) -> np.ndarray:
        return to_box(track.filter.value)

    def overlap(self, boxes: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return box_iou(boxes, expected)

    def counters(self) -> tuple[int, int]:
        """Frames so far and the next id: what a state keeps beside the tracks."""
        return self.frames, self.next_id

    def track_rows(self) -> dict[int, tuple]:
        """Each track by its id, in the order of tracks: hits, streak, missed, det_id, confirmed, and the filter's arrays."""
        return {t.id: (t.hits, t.streak, t.missed, t.det_id, True, *filter_arrays(t.filter)) for t in self.tracks}

    def with_state(self, counters: tuple[int, int], rows: dict[int, tuple]) -> Sort:
        self.frames, self.next_id = counters
        self.tracks = [Track(i, BoxFilter(*map(np.array, state)), hits, streak, missed, det) for i, (hits, streak, missed, det, _, *state) in sorted(rows.items())]
        return self

    def match(self, boxes: np.ndarray, expected: np.ndarray) -> list[tuple[int, int]]:
        """Pairs where each overlaps no other, without a solver; else those of the best assignment, if they overlap enough."""
        if not len(boxes) or not len(expected):
            return []
        overlap = self.overlap(boxes, expected)
        strong = overlap > self.least_iou
        if strong.any() and strong.sum(1).max() == 1 and strong.sum(0).max() == 1:
            pairs = list(zip(*(x.tolist() for x in np.nonzero(strong)), strict=True))
        else:
            pairs = assign(-overlap)
        return [(d, k) for d, k in pairs if overlap[d, k] >= self.least_iou]


class SortTurned(Sort):
    """Sort on boxes cx, cy, w, h, theta whose longer side is w; the angle is a fifth value of the filter and overlap is that of the turned figures."""

    columns = ("cx", "cy", "w", "h", "theta")
    out = TURNED

    def state(self, box: np.ndarray, track: Track | None = None) -> np.ndarray:
        """The angle nearest to the track's, of those that mean the same box."""
        state = to_turned_state(box)
        if track is not None:
            state[4] -= np.pi * np.round((state[4] - track.filter.value[4]) / np.pi)
        return state

    def shown(self, track: Track) -> np.ndarray:
        x, y, area, ratio, theta = track.filter.value
        w = np.sqrt(area * ratio) if area * ratio >= 0 else np.nan
        return np.array([x, y, w, area / w if w > 0 else 0.0, (theta + np.pi / 2) % np.pi - np.pi / 2])

    def overlap(self, boxes: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return turned_iou(boxes, expected)


def turned_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[len(a), len(b)] for boxes cx, cy, w, h, theta. Figures whose bounds don't meet aren't cut."""
    p, q = corners_of(a), corners_of(b)
    hull = lambda c: np.concatenate([c.min(1), c.max(1)], 1)
    out = np.zeros((len(a), len(b)))
    i, j = np.nonzero(box_iou(hull(p), hull(q)) > 0)
    out[i, j] = figures_iou(p[i], q[j])
    return out


def paired_turned_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """turned_iou() of corners a[i] with corners b[i], each [n, 4, 2]."""
    (al, ar), (bl, br) = ((c.min(1), c.max(1)) for c in (a, b))
    side = np.maximum(np.minimum(ar, br) - np.maximum(al, bl), 0)
    at = np.flatnonzero(side[:, 0] * side[:, 1] > 0)
    out = np.zeros(len(a))
    out[at] = figures_iou(a[at], b[at])
    return out


class TurnedSideBySide:
    """Many videos by SortTurned, each a frame further at a time: what step() gives for each of them alone.

    All tracks of the videos at hand lie in arrays, those of a video together, in the order in which they began; a video is a number from 0 on.
    """

    def __init__(self, one: SortTurned) -> None:
        self.one = one

    def begin(self, videos: int) -> None:
        """Tracks of no video yet; frames so far and next id of each."""
        self.frames, self.next_id = np.zeros(videos, np.int64), np.ones(videos, np.int64)
        self.tracks = self._tracks(np.zeros((0, 5)), *[np.zeros(0, np.int64)] * 3)

    @staticmethod
    def _tracks(states: np.ndarray, video: np.ndarray, ids: np.ndarray, det_ids: np.ndarray) -> dict[str, np.ndarray]:
        f, none = BoxFilter(states), np.zeros(len(states), np.int64)
        return {"value": f.value, "speed": f.speed, "p": f.p, "c": f.c, "v": f.v, "video": video, "id": ids, "det_id": det_ids, "streak": none, "missed": none.copy()}

    def taken(self, which: np.ndarray) -> dict[str, np.ndarray]:
        return {k: a[which] for k, a in self.tracks.items()}

    @staticmethod
    def states(boxes: np.ndarray) -> np.ndarray:
        """to_turned_state() of each box."""
        x, y, w, h, theta = boxes.T
        theta = np.where(w < h, theta + np.pi / 2, theta)
        w, h = np.where(w < h, h, w), np.where(w < h, w, h)
        return np.stack([x, y, w * h, w / h, (theta + np.pi / 2) % np.pi - np.pi / 2], 1)

    @staticmethod
    def shown(values: np.ndarray) -> np.ndarray:
        """SortTurned.shown() of each track."""
        x, y, area, ratio, theta = values.T
        with np.errstate(invalid="ignore", divide="ignore"):
            w = np.where(area * ratio >= 0, np.sqrt(area * ratio), np.nan)
            h = np.where(w > 0, area / w, 0.0)
        return np.stack([x, y, w, h, (theta + np.pi / 2) % np.pi - np.pi / 2], 1)

    def step(self, ids: np.ndarray, boxes: np.ndarray, video: np.ndarray, videos: int) -> tuple[np.ndarray, ...]:
        """video, track id, detection id and box of the tracks reported, of each video newest first. boxes: those of a frame of each of the first `videos` videos, in their order, best score first."""
        self.frames[:videos] += 1
        t = self.tracks
        t["streak"] = np.where(t["missed"] > 0, 0, t["streak"])
        t["missed"] = t["missed"] + 1
        f = BoxFilter(*(t[k] for k in ("value", "speed", "p", "c", "v")))
        f.predict()
        t |= {k: getattr(f, k) for k in ("value", "speed", "p", "c", "v")}
        expected = self.shown(t["value"])
        fine = np.isfinite(expected).all(1)
        if not fine.all():
            t, expected = self.tracks, expected = self.taken(fine), expected[fine]
        d, k = self.matched(boxes, video, expected, t["video"], videos)
        if len(d):
            f = BoxFilter(*(t[c][k] for c in ("value", "speed", "p", "c", "v")))
            z = self.states(boxes[d])
            z[:, 4] -= np.pi * np.round((z[:, 4] - f.value[:, 4]) / np.pi)
            f.update(z)
            for c in ("value", "speed", "p", "c", "v"):
                t[c][k] = getattr(f, c)
            t["missed"][k], t["det_id"][k] = 0, ids[d]
            t["streak"][k] += 1
        free = np.ones(len(boxes), bool)
        free[d] = False
        if free.any():
            of = video[free]
            n = np.bincount(of, minlength=len(self.next_id))
            fresh = self._tracks(self.states(boxes[free]), of, self.next_id[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of], ids[free].astype(np.int64))
            self.next_id += n
            order = np.argsort(np.concatenate([t["video"], of]), kind="stable")
            t = self.tracks = {c: np.concatenate([t[c], fresh[c]])[order] for c in t}
        told = np.flatnonzero((t["missed"] < 1) & ((t["streak"] >= self.one.min_hits) | (self.frames[t["video"]] <= self.one.min_hits)))
        told = told[np.lexsort((-told, t["video"][told]))]
        out = t["video"][told], t["id"][told], t["det_id"][told], self.shown(t["value"][told])
        stays = t["missed"] <= self.one.max_age
        if not stays.all():
            self.tracks = self.taken(stays)
        return out

    def matched(self, boxes: np.ndarray, video: np.ndarray, expected: np.ndarray, of: np.ndarray, videos: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of boxes and tracks that SortTurned.match() pairs in each video."""
        least = self.one.least_iou
        held = np.bincount(of, minlength=videos)
        n = held[video]
        i = np.repeat(np.arange(len(boxes)), n)
        j = (np.cumsum(held) - held)[video][i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        overlap = paired_turned_iou(corners_of(boxes)[i], corners_of(expected)[j])
        strong, whose = overlap > least, video[i]
        clash, any_strong, close = (np.zeros(videos, bool) for _ in range(3))
        any_strong[whose[strong]] = True
        close[whose[overlap >= least]] = True
        clash[video[np.bincount(i[strong], minlength=len(boxes)) > 1]] = True
        clash[of[np.bincount(j[strong], minlength=len(of)) > 1]] = True
        plain = any_strong & ~clash
        at = [np.flatnonzero(strong & plain[whose])]
        # Without a close pair no assignment would hold.
        for v in np.flatnonzero(close & ~plain).tolist():
            lo, hi = np.searchsorted(whose, (v, v + 1)).tolist()
            table = overlap[lo:hi].reshape(-1, held[v])
            pairs = assign(-table) if min(table.shape) > 1 else [divmod(int(table.argmax()), table.shape[1])]
            at.append(lo + np.array([r * held[v] + c for r, c in pairs if table[r, c] >= least], np.int64))
        at = np.concatenate(at)
        return i[at], j[at]

    def alone(self, video: int) -> SortTurned:
        """A tracker of its own that goes on with the video."""
        t = self.taken(self.tracks["video"] == video)
        rows = {int(i): (0, int(t["streak"][k]), int(t["missed"][k]), int(t["det_id"][k]), True, *(t[c][k] for c in ("value", "speed", "p", "c", "v"))) for k, i in enumerate(t["id"])}
        return replace(self.one, tracks=[]).with_state((int(self.frames[video]), int(self.next_id[video])), rows)

    def go_on(self, video: int, one: SortTurned) -> None:
        """Takes on what the tracker holds, as the video's; there are no other tracks yet."""
        self.frames[video], self.next_id[video] = one.counters()
        if one.tracks:
            numbers = np.array([(t.id, t.det_id, t.streak, t.missed) for t in one.tracks], np.int64).T
            filters = {c: np.stack([getattr(t.filter, c) for t in one.tracks]) for c in ("value", "speed", "p", "c", "v")}
            self.tracks = filters | dict(zip(("id", "det_id", "streak", "missed"), numbers.copy(), strict=True)) | {"video": np.full(len(one.tracks), video)}

    def walk(self, frames: Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
        """frames: the video of each frame (frames of a video together, in order), where each frame's boxes begin, with the end, their det_ids and boxes. Gives the frame's place beside what step() gives."""
        key, kept = object(), None
        for videos, offsets, ids, boxes in frames:
            starts = np.array([r for r in range(len(videos)) if r == 0 or videos[r] != videos[r - 1]], np.int64)
            lengths = np.diff(np.append(starts, len(videos)))
            order = np.argsort(-lengths, kind="stable")
            starts, lengths = starts[order], lengths[order]
            self.begin(len(starts))
            if videos[0] == key:  # the last video goes on
                self.go_on(int(np.flatnonzero(order == 0)[0]), kept)
            last, found = int(np.flatnonzero(order == len(order) - 1)[0]), []
            active = len(starts)
            for level in range(int(lengths[0])):
                n = int(np.searchsorted(-lengths, -level))
                if n < active:
                    if n <= last < active:
                        kept = self.alone(last)
                    self.tracks, active = self.taken(self.tracks["video"] < n), n
                if n <= NARROW:
                    for video in range(n):
                        one = self.alone(video)
                        told = [(r, *x) for r in range(starts[video] + level, starts[video] + lengths[video]) for x in one.step(ids[offsets[r] : offsets[r + 1]], boxes[offsets[r] : offsets[r + 1]])]
                        if told:
                            found.append(tuple(np.array(c) for c in zip(*told, strict=True)))
                        if video == last:
                            kept = one
                    active = 0
                    break
                rows = starts[:n] + level
                counts = offsets[rows + 1] - offsets[rows]
                at = np.repeat(offsets[rows] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                of, *told = self.step(ids[at], boxes[at], np.repeat(np.arange(n), counts), n)
                found.append((rows[of], *told))
            if last < active:
                kept = self.alone(last)
            key = videos[-1]
            if not found:
                continue
            found = [np.concatenate(c) for c in zip(*found, strict=True)]
            by_row = np.argsort(found[0], kind="stable")
            yield tuple(c[by_row] for c in found)


@dataclass
class Seen:
    """A track of DeepSort: tentative until it has enough hits."""

    id: int
    filter: HeightFilter
    det_id: int
    hits: int = 1
    missed: int = 0
    confirmed: bool = False
    fresh: list[np.ndarray] = field(default_factory=list)  # features since the gallery was last filled
    gallery: list[np.ndarray] = field(default_factory=list)
    seen: int = 0  # features that have come into the gallery, those that have left it included
    unit: np.ndarray | None = None  # the gallery's features at length one, a row each, until it changes


@dataclass
class DeepSort:
    """Tracks of one video by motion and appearance.

    Confirmed tracks are matched first, those seen most recently before others, by the least distance (of that name in functions.distances.METRICS) to the features that their gallery
    keeps, among boxes within the gate of their filter. What is left, with tentative tracks, is matched by overlap. A tentative
    track goes at its first miss, a confirmed one after max_age of them; it is reported until it has been missed twice.
    """

    max_age: int = 70
    min_hits: int = 3
    most_distance: float = 0.2
    most_iou_distance: float = 0.7
    budget: int = 100
    metric: str = "cosine"
    next_id: int = 1
    tracks: list[Seen] = field(default_factory=list)

    columns = ("l", "t", "r", "b")
    out = TRACKED

    def step(self, ids: np.ndarray, boxes: np.ndarray, features: np.ndarray | None = None) -> list[tuple[int, int, np.ndarray]]:
        for t in self.tracks:
            t.filter.predict()
            t.missed += 1
        forms = np.array([to_height_form(b) for b in boxes]).reshape(-1, 4)
        pairs = self.matched(boxes, forms, features)
        for d, t in pairs:
            t.filter.update(forms[d])
            t.hits, t.missed, t.det_id = t.hits + 1, 0, int(ids[d])
            t.confirmed = t.confirmed or t.hits >= self.min_hits
            if features is not None:
                t.fresh.append(features[d])
        self.tracks = [t for t in self.tracks if t.missed == 0 or (t.confirmed and t.missed <= self.max_age)]
        for d in sorted({*range(len(boxes))} - {d for d, _ in pairs}):
            fresh = [] if features is None else [features[d]]
            self.tracks.append(Seen(self.next_id, HeightFilter(forms[d]), int(ids[d]), confirmed=self.min_hits <= 1, fresh=fresh))
            self.next_id += 1
        for t in self.tracks:
            if t.confirmed and t.fresh:
                t.gallery, t.seen, t.fresh, t.unit = [*t.gallery, *t.fresh][-self.budget :], t.seen + len(t.fresh), [], None
        return [(t.id, t.det_id, from_height_form(t.filter.value)) for t in self.tracks if t.confirmed and t.missed <= 1]

    def matched(self, boxes: np.ndarray, forms: np.ndarray, features: np.ndarray | None) -> list[tuple[int, Seen]]:
        out, open_boxes = [], list(range(len(boxes)))
        known = [t for t in self.tracks if t.confirmed]
        if features is not None:
            for age in sorted({t.missed for t in known}):
                level = [t for t in known if t.missed == age]
                pairs = within(appearance(level, forms[open_boxes], features[open_boxes], self.metric), self.most_distance)
                out += [(open_boxes[d], level[k]) for k, d in pairs]
                open_boxes = [d for d in open_boxes if d not in {x for x, _ in out}]
        done = {t.id for _, t in out}
        rest = [t for t in self.tracks if t.id not in done and (not t.confirmed or t.missed == 1)]
        expected = np.array([from_height_form(t.filter.value) for t in rest]).reshape(-1, 4)
        pairs = within(1 - box_iou(expected, boxes[open_boxes]), self.most_iou_distance) if rest and open_boxes else []
        return out + [(open_boxes[d], rest[k]) for k, d in pairs]

    def counters(self) -> tuple[int, int]:
        return 0, self.next_id

    def track_rows(self) -> dict[int, tuple]:
        return {t.id: (t.hits, 0, t.missed, t.det_id, t.confirmed, *filter_arrays(t.filter)) for t in self.tracks}

    def with_state(self, counters: tuple[int, int], rows: dict[int, tuple]) -> DeepSort:
        self.next_id = counters[1]
        self.tracks = [Seen(i, HeightFilter(*map(np.array, state)), det, hits, missed, confirmed) for i, (hits, _, missed, det, confirmed, *state) in sorted(rows.items())]
        return self


def filter_arrays(f: BoxFilter | HeightFilter) -> list[list[float]]:
    return [x.tolist() for x in (f.value, f.speed, f.p, f.c, f.v)]


def within(cost: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Pairs of the least assignment whose costs are at most `most`; greater ones all count alike, a little more than it."""
    pairs = assign(np.where(cost > most, most + 1e-5, cost))
    return [(i, j) for i, j in pairs if cost[i, j] <= most]


def appearance(tracks: list[Seen], forms: np.ndarray, features: np.ndarray, metric: str = "cosine") -> np.ndarray:
    """[tracks, boxes]: least distance to a track's gallery; NEVER for boxes outside the gate of its filter."""
    out = np.full((len(tracks), len(forms)), NEVER)
    held = [k for k, t in enumerate(tracks) if t.gallery]
    if not held or not len(forms):
        return out
    starts = np.cumsum([0, *(len(tracks[k].gallery) for k in held[:-1])])
    if metric == "cosine":
        for k in held:
            if tracks[k].unit is None:
                tracks[k].unit = at_length_one(np.array(tracks[k].gallery))
        far = 1 - np.concatenate([tracks[k].unit for k in held]) @ at_length_one(features).T
    else:
        far = METRICS[metric](np.array([f for k in held for f in tracks[k].gallery]), features)
    near = np.minimum.reduceat(far, starts, axis=0)
    filters = HeightFilter(*(np.stack([getattr(tracks[k].filter, n) for k in held])[:, None] for n in ("value", "speed", "p", "c", "v")))
    out[held] = np.where(filters.distance(forms[None]) > GATE[4], NEVER, near)
    return out


def at_length_one(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def to_height_form(box: np.ndarray) -> np.ndarray:
    """left, top, right, bottom to centre, aspect, height."""
    w, h = box[2] - box[0], box[3] - box[1]
    return np.array([box[0] + w / 2, box[1] + h / 2, w / h, h])


def from_height_form(form: np.ndarray) -> np.ndarray:
    w, h = form[2] * form[3], form[3]
    return np.array([form[0] - w / 2, form[1] - h / 2, form[0] + w / 2, form[1] + h / 2])


#: Tracker by name. A tracker has columns, out and step(ids, boxes, features); its settings are its constructor's.
TRACKERS: dict[str, Callable[..., Sort | SortTurned | DeepSort]] = {"sort": Sort, "sort_turned": SortTurned, "deep_sort": DeepSort}
#: Trackers that take many videos on at a time; those made from them go on alone.
SIDE_BY_SIDE = {SortTurned: TurnedSideBySide}


def by_frame(boxes: DataFrame, key: str, columns: tuple[str, ...], feature: str | None) -> DataFrame:
    """One row a frame: its boxes in order of score (best first), then det_id."""
    fields = [(-F.col("score").cast("double")).alias("s"), F.col("det_id").cast("int").alias("det_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("box")]
    fields += [F.col(feature).cast("array<double>").alias("feature")] if feature else []
    return boxes.groupBy(key, "frame_index").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("boxes"))


def frame_values(column: pa.ListArray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """det_ids, boxes and features of each row of by_frame, cut from whole columns."""
    rows = column.flatten()
    ids, boxes = rows.field("det_id").to_numpy(), rows.field("box").flatten().to_numpy().reshape(-1, width)
    named = [f.name for f in rows.type]
    features = np.array(rows.field("feature").to_pylist()) if "feature" in named and len(rows) else None
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    for lo, hi in zip(np.concatenate([[0], ends[:-1]]).tolist() if len(ends) else [], ends.tolist(), strict=True):
        yield ids[lo:hi], boxes[lo:hi], None if features is None else features[lo:hi]


def walked_schema(df: DataFrame, key: str, fields: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(key, df.schema[key].dataType), *T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in fields)).fields])


def walked(rows: DataFrame, key: str, order: str, schema: T.StructType, begin: Callable[[], object], step: Callable[[object, dict[str, object]], list[tuple]]) -> DataFrame:
    """A fold of each key's rows in order: step(state, row) gives the rows (without the key) to put out. Only the state at hand is held."""
    kinds, names = [to_arrow_type(f.dataType) for f in schema.fields], [f.name for f in schema.fields]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row[key] != at:
                    at, state = row[key], begin()
                found += [(at, *x) for x in step(state, row)]
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(walk, schema)


def track(boxes: DataFrame, video: str = "video_id", method: str = "sort", feature: str | None = None, least_score: float | None = None, **settings) -> DataFrame:
    """Tracked boxes of each video, by the tracker of that name. Ids count from 1 in each video.

    boxes: video, frame_index, det_id, score and the tracker's columns; feature names an array column for trackers by appearance.
    """
    tracker = TRACKERS[method]
    shown = tracker()
    schema = T.StructType([T.StructField(video, boxes.schema[video].dataType), *T._parse_datatype_string(shown.out).fields])
    kinds, names, width = [to_arrow_type(f.dataType) for f in schema.fields], [f.name for f in schema.fields], len(shown.columns)
    boxes = boxes if least_score is None else boxes.filter(F.col("score") > least_score)

    def side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def frames() -> Iterator[tuple]:
            rows: list[pa.RecordBatch] = []
            for batch in batches:
                rows += [batch] if batch.num_rows else []
                if sum(b.num_rows for b in rows) >= HELD:
                    yield whole(rows)
                    rows = []
            if rows:
                yield whole(rows)

        def whole(rows: list[pa.RecordBatch]) -> tuple:
            held[:] = [pa.Table.from_batches(rows)]
            lists = held[0].column(2).combine_chunks()
            flat = lists.flatten()
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            return held[0].column(0).to_pylist(), offsets, flat.field("det_id").to_numpy(), flat.field("box").flatten().to_numpy().reshape(-1, width)

        for at, ids, det_ids, values in SIDE_BY_SIDE[tracker](tracker(**settings)).walk(frames()):
            of = held[0].select([0, 1]).combine_chunks().take(pa.array(at))
            columns = [of.column(0), of.column(1), pa.array(ids), pa.array(det_ids), *[pa.array(np.ascontiguousarray(c)) for c in values.T]]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tracker in SIDE_BY_SIDE:
            yield from side_by_side(batches)
            return
        at, state = object(), None
        for batch in batches:
            found = []
            videos, frames = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for v, f, (ids, values, features) in zip(videos, frames, frame_values(batch.column(2), width), strict=True):
                if v != at:
                    at, state = v, tracker(**settings)
                found += [(v, f, t, d, *box) for t, d, box in state.step(ids, values, features)]
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    frames = by_frame(boxes, video, shown.columns, feature).select(video, "frame_index", "boxes")
    return frames.repartition(video).sortWithinPartitions(video, "frame_index").mapInArrow(walk, schema)


def stepped(values: np.ndarray, keys: np.ndarray, carried: tuple | None, make: Callable[[np.ndarray], Filter], step: Callable[[Filter, np.ndarray], np.ndarray], begin: Callable[[Filter], np.ndarray]) -> tuple[np.ndarray, tuple]:
    """What a filter gives for each row of values [rows, measurement]; rows of a key stand together, in order. All keys go on together, a measurement at a time.

    carried: the key and filter that the batch before ended with; the like of this one is the second result. begin and step give a row of the result.
    """
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    lengths = np.diff(np.append(starts, len(keys)))
    out: np.ndarray | None = None

    def put(at: np.ndarray, found: np.ndarray) -> None:
        nonlocal out
        if out is None:
            out = np.zeros((len(keys), found.shape[-1]))
        out[at] = found

    goes_on = carried is not None and carried[0] == keys[0]
    now = None
    if goes_on:
        now = carried[1]
        for i in range(lengths[0]):
            put(np.array([i]), step(now, values[i : i + 1]))
        starts, lengths = starts[1:], lengths[1:]
    if len(starts):
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        state, ends_last = make(values[at]), int(np.flatnonzero(order == len(order) - 1)[0])
        put(at, begin(state))
        for i in range(1, left[0] + 1):
            if left[ends_last] == i:  # the batch's last key stops here, and may go on in the next batch
                now = type(state)(*(getattr(state, name)[ends_last : ends_last + 1].copy() for name in state.__dataclass_fields__))
            n = int(np.searchsorted(-left, -i))
            if n:
                state = first(state, n)
                put(at[:n] + i, step(state, values[at[:n] + i]))
    return out, (keys[-1], now)


def _filtered(points: DataFrame, key: str, order: str, values: list[str], schema: T.StructType, make: Callable[[np.ndarray], Filter], step: Callable[[Filter, np.ndarray], np.ndarray], begin: Callable[[Filter], np.ndarray]) -> DataFrame:
    """A filter over each key's rows in order. schema: key, order and what step gives; rows whose first value is nan are left out."""
    names = [f.name for f in schema.fields]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                z = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(2, batch.num_columns)], 1)
                found, carried = stepped(z, keys, carried, make, step, begin)
                told = pa.array(~np.isnan(found[:, 0]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in found.T]], names).filter(told)

    rows = points.select(key, F.col(order).cast("long").alias(order), *[F.col(v).cast("double") for v in values])
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(walk, schema)


def _smoothed(points: DataFrame, key: str, order: str, values: list[str], make: Callable[[np.ndarray], Filter], width: int) -> DataFrame:
    schema = walked_schema(points, key, [(order, "long"), *[(f"f{i}", "double") for i in range(width)]])

    def step(f: Filter, z: np.ndarray) -> np.ndarray:
        f.predict()
        f.update(z)
        return f.value

    return _filtered(points, key, order, values, schema, make, step, lambda f: f.value)


def filtered(points: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Each key's measurements (centre x, centre y, area, ratio) smoothed by the box filter, one row a measurement."""
    return _smoothed(points, key, order, values, BoxFilter, 4)


def filtered_by_height(points: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Each key's measurements (centre x, centre y, aspect, height) by the filter whose noise follows the height."""
    return _smoothed(points, key, order, values, HeightFilter, 4)


def filtered_by_turn(points: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Each key's measurements (x, y, yaw, width, height) by the filter of constant speed and turn rate: f0 to f7 are x, y, yaw, their speeds, width and height."""
    return _smoothed(points, key, order, values, TurnFilter, 8)


def gated_by_height(points: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """key, order, d2: squared distance of each measurement but the first to what the filter by height expects, in the filter's own covariance."""
    schema = walked_schema(points, key, [(order, "long"), ("d2", "double")])

    def step(f: Filter, z: np.ndarray) -> np.ndarray:
        f.predict()
        far = f.distance(z)
        f.update(z)
        return far[:, None]

    return _filtered(points, key, order, values, schema, HeightFilter, step, lambda f: np.full((len(f.value), 1), np.nan))
