"""Points of a video against all polygons and lines of its road, in whole columns."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Points times edges that meet at once.
ROWS = 1 << 18


def runs(columns: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """First and last + 1 of each run of rows that are alike in all columns; nulls are alike."""
    n = len(columns[0])
    changes = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(n - 1, 0))
        changes |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), n]
    return ((lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi > lo)


def corners(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x and y of all points of the lists, and where each list begins, with the end."""
    flat = rings.flatten()
    starts = np.concatenate([[0], np.cumsum(rings.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
    x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    return x, y, starts


class Road:
    """Polygons in their order. rows: ord, lane, ring of three points or more, and for along() line, base, start, per_pixel."""

    def __init__(self, rows: pa.StructArray) -> None:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("ord", "ascending"), ("lane", "ascending")])) if len(rows) > 1 else rows
        self.rows, self.lanes = rows, rows.field("lane")
        x, y, starts = corners(rows.field("ring"))
        after = np.arange(1, len(x) + 1)
        after[starts[1:] - 1] = starts[:-1]
        self.starts = starts[:-1]
        self.x1, self.y1, self.x2, self.y2 = x, y, x[after], y[after]
        with np.errstate(divide="ignore"):
            self.rise = np.where(self.y2 == self.y1, np.nan, self.y2 - self.y1)
        self.lines: dict[int, tuple] = {}

    def first_that_holds(self, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """The place of the first polygon that holds each point, or -1. Even-odd rule; points on an edge or a corner are outside."""
        step = max(1, ROWS // len(self.x1))
        return np.concatenate([self._first(px[lo : lo + step, None], py[lo : lo + step, None]) for lo in range(0, len(px), step)])

    def _first(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x1, y1, x2, y2 = self.x1, self.y1, self.x2, self.y2
        spans = ((y1 < y) & (y <= y2)) | ((y2 < y) & (y <= y1))
        with np.errstate(invalid="ignore", over="ignore"):
            odd = np.logical_xor.reduceat(spans & (x1 + (y - y1) / self.rise * (x2 - x1) < x), self.starts, axis=1)
            level = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) == 0
        near = (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2)) & (y >= np.minimum(y1, y2)) & (y <= np.maximum(y1, y2))
        holds = odd & ~np.logical_or.reduceat(level & near, self.starts, axis=1)
        return np.where(holds.any(1), holds.argmax(1), -1)

    def _line(self, k: int) -> tuple:
        """Segments of a polygon's line, what of it lies before each of them, and base, start, per_pixel."""
        if k not in self.lines:
            row = self.rows.slice(k, 1)
            x, y, _ = corners(row.field("line"))
            dx, dy = np.diff(x), np.diff(y)
            square = dx * dx + dy * dy
            length = np.sqrt(square)
            before = np.concatenate([[0.0], np.cumsum(length)])[: len(dx)]
            numbers = [row.field(c).to_numpy(zero_copy_only=False).astype(float)[0] for c in ("base", "start", "per_pixel")]
            self.lines[k] = (x[:-1], y[:-1], dx, dy, square, length, before, *numbers)
        return self.lines[k]

    def along(self, px: np.ndarray, py: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place along the line of polygon at[i] and distance from it, in its units; of equally near segments the first counts. nan where at is -1."""
        pos, beside = np.full(len(px), np.nan), np.full(len(px), np.nan)
        for k in np.unique(at[at >= 0]).tolist():
            ax, ay, dx, dy, square, length, before, base, start, per_pixel = self._line(k)
            own = np.flatnonzero(at == k)
            on, far = np.zeros(len(own)), np.full(len(own), np.inf)
            step = max(1, ROWS // max(1, len(dx)))
            for lo in range(0, len(own) if len(dx) else 0, step):
                x, y = px[own[lo : lo + step], None], py[own[lo : lo + step], None]
                t = ((x - ax) * dx + (y - ay) * dy) / np.where(square == 0, np.inf, square)
                t = np.maximum(0.0, np.minimum(1.0, t))
                u, v = x - ax - t * dx, y - ay - t * dy
                dist = np.sqrt(u * u + v * v)
                best = dist.argmin(1)
                each = np.arange(len(best))
                far[lo : lo + step], on[lo : lo + step] = dist[each, best], (before + t * length)[each, best]
            pos[own], beside[own] = (on - base) * per_pixel + start, far * per_pixel
        return pos, beside
