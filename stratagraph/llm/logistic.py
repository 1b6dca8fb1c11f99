"""Regularised logistic regression on sparse rows, and its calibration; the rows are a bounded sample, fitted on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Rows of (feature number, value); row r has the items from first[r] to first[r + 1]."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray
    size: int

    def __post_init__(self) -> None:
        self.row = np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.first) - 1, w.shape[1]))
        for a, b in self.chunks():
            for k in range(w.shape[1]):
                out[:, k] += np.bincount(self.row[a:b], self.value[a:b] * w[self.index[a:b], k], minlength=len(out))
        return out

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, g.shape[1]))
        for a, b in self.chunks():
            for k in range(g.shape[1]):
                out[:, k] += np.bincount(self.index[a:b], self.value[a:b] * g[self.row[a:b], k], minlength=self.size)
        return out

    def chunks(self, size: int = 1 << 20) -> list[tuple[int, int]]:
        """Stretches of items, so that products of them stay small."""
        return [(a, min(a + size, len(self.index))) for a in range(0, len(self.index), size)]

    def rows(self, some: np.ndarray) -> Sparse:
        n = np.diff(self.first)[some]
        first = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.first[:-1][some] - first[:-1], n) + np.arange(first[-1])
        return Sparse(self.index[at], self.value[at], first, self.size)


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 100, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """The point that limited-memory BFGS with backtracking gets to."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(grad).max(initial=0) < tolerance:
            break
        d, coef = -grad, []
        for s, y, rho in reversed(past):
            coef.append(rho * (s @ d))
            d = d - coef[-1] * y
        if past:
            s, y, rho = past[-1]
            d = d / (rho * (y @ y))
        for (s, y, rho), a in zip(past, reversed(coef)):
            d = d + (a - rho * (y @ d)) * s
        slope, step = grad @ d, 1.0 if past else min(1.0, 1 / max(1e-12, np.abs(grad).sum()))
        while True:
            new = x + step * d
            new_value, new_grad = f(new)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
            if step < 1e-12:
                return x
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y, 1 / (s @ y))]
        x, value, grad = new, new_value, new_grad
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: Sparse, y: np.ndarray, l2: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features by columns) and biases. y: rows by 1 with 0 and 1 (two classes), or rows by classes, one-hot."""
    k, n = y.shape[1], max(1, len(y))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = p[:-k].reshape(-1, k), p[-k:]
        s = x.times(w) + b
        if k == 1:
            value, g = np.logaddexp(0, s).sum() - (y * s).sum(), sigmoid(s) - y
        else:
            q = softmax(s)
            value, g = -np.log(np.maximum(q, 1e-300))[y > 0].sum(), q - y
        grad = np.concatenate([(x.transposed_times(g) / n + l2 * w).reshape(-1), g.sum(axis=0) / n])
        return value / n + l2 / 2 * float((w * w).sum()), grad

    p = lbfgs(loss, np.zeros((x.size + 1) * k), rounds)
    return p[:-k].reshape(-1, k), p[-k:]


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) such that sigmoid(a * score + b) is the probability of y = 1, with targets drawn in by Platt's counts."""
    good = max(1, int((y > 0).sum()))
    bad = max(1, len(y) - int((y > 0).sum()))
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        s = p[0] * score + p[1]
        g = sigmoid(s) - t
        return float((np.logaddexp(0, s) - t * s).sum() / max(1, len(t))), np.array([g @ score, g.sum()]) / max(1, len(t))

    a, b = lbfgs(loss, np.array([1.0, 0.0]), 200, tolerance=1e-8)
    return float(a), float(b)


def temperature(score: np.ndarray, y: np.ndarray) -> float:
    """The factor on the scores under which softmax gives held-out rows (one-hot y) the highest likelihood."""
    tried = np.geomspace(0.05, 5, 60)
    cost = [-np.log(np.maximum(softmax(t * score), 1e-300))[y > 0].sum() for t in tried]
    return float(tried[int(np.argmin(cost))])
