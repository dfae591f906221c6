"""Linear models fitted on bounded samples: hinge loss by dual coordinate descent, and logistic scaling."""

from __future__ import annotations

import numpy as np


def hinge(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Weights of a linear support vector machine, the last one a bias.

    `rows` are sparse (places, values), `y` is +1 or -1, `cost` bounds each row's dual variable.  One dual
    variable after another is moved to its best value, in a fixed shuffled order, until none moves much.
    """
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    squares = np.array([float((v * v).sum()) + 1.0 for _, v in rows])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)).tolist():
            at, value = rows[i]
            slope = y[i] * (float(value @ w[at]) + w[size]) - 1.0
            new = min(max(alpha[i] - slope / squares[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                most = max(most, abs(step) / cost[i])
                alpha[i] = new
                w[at] += step * y[i] * value
                w[size] += step * y[i]
        if most < 0.01:
            break
    return w


def balanced(y: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """A bound for each row so that both classes weigh the same."""
    share = np.where(y > 0, (y > 0).mean(), (y <= 0).mean())
    return cost * 0.5 / np.maximum(share, 1e-3)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model of a few columns, the last one a bias, by Newton steps with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = probability(x @ w)
        slope = x.T @ (y - p) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -60, 60)))
