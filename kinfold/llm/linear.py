"""Linear models over sparse rows in numpy: rows are flat feature numbers with offsets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def margins(weights: np.ndarray, bias: float, index: np.ndarray, value: np.ndarray | None, cut: np.ndarray) -> np.ndarray:
    """The weighted sum of every row."""
    terms = weights[index] if value is None else weights[index] * value
    total = np.concatenate([[0.0], np.cumsum(terms, dtype=np.float64)])
    return total[cut[1:]] - total[cut[:-1]] + bias


class Adam:
    """Adam steps on weights and a bias, with weight decay."""

    def __init__(self, size: int, rate: float, decay: float):
        self.weights, self.bias, self.rate, self.decay = np.zeros(size), 0.0, rate, decay
        self.m, self.v, self.t = np.zeros(size + 1), np.zeros(size + 1), 0

    def step(self, slope: np.ndarray, index: np.ndarray, value: np.ndarray | None, cut: np.ndarray) -> None:
        """slope: the derivative of the loss by each row's margin."""
        each = np.repeat(slope, np.diff(cut))
        g = np.append(np.bincount(index, each if value is None else each * value, len(self.weights)) + self.decay * self.weights, slope.sum())
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        move = self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)
        self.weights -= move[:-1]
        self.bias -= move[-1]


def rows_of(cut: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the features of the picked rows, and the offsets of the new rows."""
    n = np.diff(cut)[pick]
    new = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(cut[pick] - new[:-1], n) + np.arange(new[-1]), new


def fit(size: int, index: np.ndarray, value: np.ndarray | None, cut: np.ndarray, slope: Callable[[np.ndarray, np.ndarray], np.ndarray], batches: list[np.ndarray], rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Weights and bias after a step on every batch; slope(margins, rows) gives the loss's derivative."""
    model = Adam(size, rate, decay)
    for pick in batches:
        at, new = rows_of(cut, pick)
        i, v = index[at], None if value is None else value[at]
        model.step(slope(margins(model.weights, model.bias, i, v, new), pick), i, v, new)
    return model.weights, model.bias
