"""Distances between vectors, each with each, by name."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np


def cosine_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[len(a), len(b)]: one less the cosine; nan for vectors of no length."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - (a @ b.T) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None])


def squared_euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[len(a), len(b)] of squared distances, from differences, so near vectors lose no digits."""
    return np.stack([((a - v) ** 2).sum(1) for v in b], 1) if len(b) else np.zeros((len(a), 0))


METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"cosine": cosine_distance, "euclidean": squared_euclidean}
