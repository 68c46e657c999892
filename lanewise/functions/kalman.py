"""Filters of tracks. Values lie along the last axis, so one object is one track or, with a first axis, many at once.

Constant-velocity filters are scalar recurrences: with diagonal noise the state falls apart into pairs (value, speed). The filter by turn rate keeps its whole covariance.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Fixed values of the published tracker, by (centre x, centre y, area, ratio): measurement noise, noise of values and of speeds, start.
NOISE = {"r": (1.0, 1.0, 10.0, 10.0), "q": (1.0, 1.0, 1.0, 1.0), "q_speed": (0.01, 0.01, 1e-4), "p": 10.0, "p_speed": 1e4}


@dataclass
class BoxFilter:
    """State of one track: centre, area and ratio, speeds of the first three. The rotated form carries an angle as a fifth value."""

    value: np.ndarray
    speed: np.ndarray | None = None
    p: np.ndarray | None = None  # variance of the values
    c: np.ndarray | None = None  # covariance of value and speed
    v: np.ndarray | None = None  # variance of the speeds

    def __post_init__(self):
        self.value = np.array(self.value, float)
        n, moving = self.value.shape[-1], (*self.value.shape[:-1], 3)
        if self.p is None:
            self.speed, self.p, self.c, self.v = np.zeros(moving), np.full(self.value.shape, NOISE["p"]), np.zeros(moving), np.full(moving, NOISE["p_speed"])
        self.q = np.array([*NOISE["q"], 0.0][:n])
        self.r = np.array([*NOISE["r"], 10.0][:n])

    def predict(self) -> np.ndarray:
        self.speed[..., 2] = np.where(self.value[..., 2] + self.speed[..., 2] <= 0, 0.0, self.speed[..., 2])
        self.value[..., :3] += self.speed
        self.p[..., :3] += 2 * self.c + self.v
        self.p += self.q
        self.c = self.c + self.v
        self.v = self.v + np.array(NOISE["q_speed"])
        return self.value

    def update(self, z: np.ndarray) -> None:
        gap, total = z - self.value, self.p + self.r
        gain, gain_speed = self.p / total, self.c / total[..., :3]
        self.value += gain * gap
        self.speed = self.speed + gain_speed * gap[..., :3]
        self.v = self.v - gain_speed * self.c
        self.c = self.c * (1 - gain[..., :3])
        self.p = self.p * (1 - gain)


def to_state(box: np.ndarray) -> np.ndarray:
    """left, top, right, bottom to centre, area, ratio."""
    w, h = box[2] - box[0], box[3] - box[1]
    return np.array([box[0] + w / 2, box[1] + h / 2, w * h, w / h])


def to_box(state: np.ndarray) -> np.ndarray:
    w = np.sqrt(max(state[2] * state[3], 0.0))
    h = state[2] / w if w > 0 else 0.0
    return np.array([state[0] - w / 2, state[1] - h / 2, state[0] + w / 2, state[1] + h / 2])


def to_turned_state(box: np.ndarray) -> np.ndarray:
    """centre, w, h, theta to centre, area, ratio, theta, with w the longer side and theta in [-pi/2, pi/2)."""
    x, y, w, h, theta = box
    if w < h:
        w, h, theta = h, w, theta + np.pi / 2
    return np.array([x, y, w * h, w / h, (theta + np.pi / 2) % np.pi - np.pi / 2])


def corners_of(boxes: np.ndarray) -> np.ndarray:
    """[n, 4, 2] of boxes centre, w, h, theta."""
    along = boxes[:, 2:3] / 2 * np.stack([np.cos(boxes[:, 4]), np.sin(boxes[:, 4])], 1)
    across = boxes[:, 3:4] / 2 * np.stack([-np.sin(boxes[:, 4]), np.cos(boxes[:, 4])], 1)
    return np.stack([boxes[:, :2] + a * along + b * across for a, b in ((1, 1), (1, -1), (-1, -1), (-1, 1))], 1)


#: Fixed values of the published filter by height: shares of the height for places and speeds; for the aspect at prediction, at projection, of its speed.
PLACE, PACE, ASPECT = 1 / 20, 1 / 160, (1e-2, 1e-1, 1e-5)


def _height_noise(height: np.ndarray, share: float, aspect: float) -> np.ndarray:
    return np.stack([share * height, share * height, np.full_like(height, aspect), share * height], -1) ** 2


@dataclass
class HeightFilter:
    """State of one track: centre, aspect and height, each with a speed; all noise but the aspect's follows the height."""

    value: np.ndarray
    speed: np.ndarray | None = None
    p: np.ndarray | None = None
    c: np.ndarray | None = None
    v: np.ndarray | None = None

    def __post_init__(self):
        self.value = np.array(self.value, float)
        if self.p is None:
            self.speed, self.c = np.zeros_like(self.value), np.zeros_like(self.value)
            self.p = _height_noise(self.value[..., 3], 2 * PLACE, ASPECT[0])
            self.v = _height_noise(self.value[..., 3], 10 * PACE, ASPECT[2])

    def predict(self) -> np.ndarray:
        q, q_speed = _height_noise(self.value[..., 3], PLACE, ASPECT[0]), _height_noise(self.value[..., 3], PACE, ASPECT[2])
        self.value = self.value + self.speed
        self.p, self.c, self.v = self.p + 2 * self.c + self.v + q, self.c + self.v, self.v + q_speed
        return self.value

    def projected(self) -> np.ndarray:
        """Variance of the measurement that is expected."""
        return self.p + _height_noise(self.value[..., 3], PLACE, ASPECT[1])

    def distance(self, z: np.ndarray, places_only: bool = False) -> np.ndarray:
        """Squared Mahalanobis distance of each measurement, of its place alone if asked."""
        n = 2 if places_only else 4
        return ((z[..., :n] - self.value[..., :n]) ** 2 / self.projected()[..., :n]).sum(-1)

    def update(self, z: np.ndarray) -> None:
        total = self.projected()
        gap, gain, gain_speed = z - self.value, self.p / total, self.c / total
        self.value, self.speed = self.value + gain * gap, self.speed + gain_speed * gap
        self.v = self.v - gain_speed * self.c
        self.c, self.p = self.c * (1 - gain), self.p * (1 - gain)


#: Fixed values of the published filter by turn rate: seconds a step; deviations of the start (places, yaw, speeds, turn rate, sides), of a measurement (place, yaw, side);
#: top speed and turn rate, and deviation of a side a step.
TURN_STEP = 0.1
TURN_START = (100.0, 100.0, math.radians(30), 500.0, 500.0, math.radians(30) / TURN_STEP, 5.0, 5.0)
TURN_MEASURED = (5.0, 5.0, math.radians(30), 10.0, 10.0)
TURN_SPEED, TURN_RATE, TURN_SIDE = 5.0, 3.0, 1.0
#: Where the measurement (x, y, yaw, w, h) stands in the state (x, y, yaw, their speeds, w, h).
MEASURED = np.array([0, 1, 2, 6, 7])


@dataclass
class TurnFilter:
    """Place and yaw with constant speeds, and sides, with the whole 8 x 8 covariance. Of the angles that mean the same yaw the one nearest to the state's is taken."""

    value: np.ndarray
    cov: np.ndarray | None = None

    def __post_init__(self):
        self.value = np.array(self.value, float)
        move = np.eye(8)
        move[[0, 1, 2], [3, 4, 5]] = TURN_STEP
        self.move = move
        self.q = np.diag(np.array([TURN_STEP * TURN_SPEED] * 2 + [TURN_STEP * TURN_RATE] + [TURN_SPEED] * 2 + [TURN_RATE] + [TURN_SIDE] * 2) ** 2)
        self.r = np.diag(np.array(TURN_MEASURED) ** 2)
        if self.cov is None:
            z, self.value = self.value, np.zeros((*self.value.shape[:-1], 8))
            self.value[..., MEASURED] = z
            self.cov = np.broadcast_to(np.diag(np.array(TURN_START) ** 2), (*self.value.shape, 8)).copy()

    def predict(self) -> np.ndarray:
        self.value = self.value @ self.move.T
        self.cov = self.move @ self.cov @ self.move.T + self.q
        return self.value

    def update(self, z: np.ndarray) -> None:
        across = self.cov[..., :, MEASURED]
        total = across[..., MEASURED, :] + self.r
        gain = np.swapaxes(np.linalg.solve(total, np.swapaxes(across, -1, -2)), -1, -2)
        gap = z - self.value[..., MEASURED]
        gap[..., 2] = np.pi - (np.pi - gap[..., 2]) % (2 * np.pi)
        self.value = self.value + (gain @ gap[..., None])[..., 0]
        self.cov = self.cov - gain @ self.cov[..., MEASURED, :]


def first(f: BoxFilter | HeightFilter | TurnFilter, n: int) -> BoxFilter | HeightFilter | TurnFilter:
    """The filter of the first n of its tracks."""
    return type(f)(*(getattr(f, name)[:n] for name in f.__dataclass_fields__))
