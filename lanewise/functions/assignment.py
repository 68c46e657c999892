"""Small numeric helpers that grouped functions use: least-cost assignment, greedy suppression, overlap of rotated boxes."""
from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, min(rows, columns) of them, by shortest augmenting paths with potentials."""
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    price_row, price_col = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        best, parent, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at_row, at_col = row, -1
        while True:
            if at_col >= 0:
                done[at_col] = True
            reach = (0.0 if at_col < 0 else best[at_col]) + cost[at_row] - price_row[at_row] - price_col
            better = ~done & (reach < best)
            best[better], parent[better] = reach[better], at_col
            at_col = int(np.where(done, np.inf, best).argmin())
            if owner[at_col] < 0:
                break
            at_row = owner[at_col]
        total = best[at_col]
        price_row[row] += total
        price_row[owner[done]] += total - best[done]
        price_col[done] -= total - best[done]
        while at_col >= 0:
            before = parent[at_col]
            owner[at_col] = row if before < 0 else owner[before]
            at_col = before
    return sorted((int(owner[c]), int(c)) for c in range(m) if owner[c] >= 0)


def box_iou(a: np.ndarray, b: np.ndarray, plus: float = 0.0) -> np.ndarray:
    """[len(a), len(b)] for boxes left, top, right, bottom; plus: what a side counts beyond its difference."""
    wide = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]) + plus
    high = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]) + plus
    both = np.maximum(wide, 0) * np.maximum(high, 0)
    area = lambda r: (r[:, 2] - r[:, 0] + plus) * (r[:, 3] - r[:, 1] + plus)
    total = area(a)[:, None] + area(b)[None] - both
    return np.where(total > 0, both / np.where(total > 0, total, 1), 0.0)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def areas(figures: np.ndarray) -> np.ndarray:
    """Of figures [n, corners, 2], corners in order; below zero if they go with the clock."""
    return _cross(figures, np.roll(figures, -1, 1)).sum(1) / 2


def shared_areas(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """[n] areas that convex figures p [n, 4, 2] share with q, pair by pair.

    The shared figure's corners are corners of either inside the other and crossings of sides; around their mean they are in the order of their angles.
    """
    p, q = (np.where(areas(f)[:, None, None] < 0, f[:, ::-1], f) for f in (p, q))
    side_p, side_q = np.roll(p, -1, 1) - p, np.roll(q, -1, 1) - q
    size = np.abs(side_p).sum((1, 2)) + np.abs(side_q).sum((1, 2))
    inside = lambda corners, f, side: (_cross(side[:, None], corners[:, :, None] - f[:, None]) >= -1e-12 * (size * size)[:, None, None]).all(2)
    turn = _cross(side_p[:, :, None], side_q[:, None])
    gap = q[:, None] - p[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = _cross(gap, side_q[:, None]) / turn, _cross(gap, side_p[:, :, None]) / turn
    met = (np.abs(turn) > 1e-14 * (size * size)[:, None, None]) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    crossings = p[:, :, None] + np.where(met, t, 0)[..., None] * side_p[:, :, None]
    n = len(p)
    corners = np.concatenate([p, q, crossings.reshape(n, 16, 2)], 1)
    held = np.concatenate([inside(p, q, side_q), inside(q, p, side_p), met.reshape(n, 16)], 1)
    count = held.sum(1)
    centre = (corners * held[..., None]).sum(1) / np.maximum(count, 1)[:, None]
    about = corners - centre[:, None]
    order = np.argsort(np.where(held, np.arctan2(about[..., 1], about[..., 0]), np.inf), axis=1)
    ring = np.take_along_axis(about, order[..., None], 1)
    ring = np.where((np.arange(24) < count[:, None])[..., None], ring, ring[:, :1])
    return np.where(count > 2, np.abs(areas(ring)), 0.0)


def figures_iou(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """[n] overlaps of convex figures of four corners, pair by pair."""
    if not len(p):
        return np.zeros(0)
    both = shared_areas(p, q)
    total = np.abs(areas(p)) + np.abs(areas(q)) - both
    return np.where(total > 0, both / np.where(total > 0, total, 1), 0.0)


def figure_iou(p: np.ndarray, q: np.ndarray) -> float:
    return float(figures_iou(np.asarray(p, float)[None], np.asarray(q, float)[None])[0])


def suppress(order: np.ndarray, overlap: np.ndarray, most: float) -> np.ndarray:
    """Which boxes stay: in the given order, one goes if a box that stays overlaps it by more than `most`."""
    keep = np.zeros(len(order), bool)
    gone = np.zeros(len(order), bool)
    for i in order:
        if not gone[i]:
            keep[i] = True
            gone |= overlap[i] > most
    return keep
