"""Small linear models fitted in numpy on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Linear support vector machine (hinge loss) by dual coordinate descent; y is -1 or 1.

    The last weight is the bias. Rows are visited in a fixed shuffled order, so the result is reproducible.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), c)
            if new != alpha[i]:
                largest = max(largest, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if largest < 1e-3:
            break
    return w


def newton(x: np.ndarray, target: np.ndarray, start: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression on a few columns, drawn towards `start`. Steps are halved until the loss falls, so it cannot diverge."""

    def loss(c: np.ndarray) -> float:
        z = x @ c
        return float((np.logaddexp(0, z) - target * z).sum() + 0.5 * ridge * ((c - start) ** 2).sum())

    c, now = start.copy(), loss(start)
    for _ in range(60):
        p = sigmoid(x @ c)
        g = x.T @ (p - target) + ridge * (c - start)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(c))
        step = np.linalg.solve(h, g)
        while loss(c - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        c, before, now = c - step, now, loss(c - step)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    return c


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve that turns margins into probabilities of y (0 or 1)."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if not pos or not neg:
        return 0.0, 8.0 if pos else -8.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))  # smoothed, so that the slope stays finite
    scale = max(float(np.std(margin)), 1e-9)
    c = newton(np.column_stack([margin / scale, np.ones(len(margin))]), target, np.array([1.0, 0.0]), 0.01)
    return float(c[0] / scale), float(c[1])


class Sparse:
    """Rows of presence features: the indices of row i are index[start[i]:start[i + 1]]."""

    def __init__(self, rows: list[np.ndarray]):
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.index = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.start))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.index], len(self.start) - 1)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, g[self.row], size)


def logistic(x: Sparse, y: np.ndarray, size: int, l2: float = 0.3, rounds: int = 120) -> np.ndarray:
    """Logistic regression over presence features, both classes with the same total weight; the last value is the bias.

    Adagrad over the whole sample: no random order, so the result is reproducible.
    """
    w, seen = np.zeros(size + 1), np.full(size + 1, 1e-6)
    pos = max(float(y.sum()), 1.0)
    weight = np.where(y > 0, len(y) / (2 * pos), len(y) / (2 * max(len(y) - pos, 1.0)))
    for _ in range(rounds):
        err = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) * weight
        g = np.append(x.back(err, size) + l2 * w[:-1], err.sum())
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    return w
