"""Logistic regression on a bounded sample, as the operators with a linear classifier fit it."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(product, transposed, y: np.ndarray, dims: int, ridge: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the cross entropy to the targets ``y`` (0 to 1) plus ``ridge`` |w|^2 / 2 for each
    row. ``product(w)`` is X w, ``transposed(r)`` X^T r. Full-batch Adam from zero: the same rows give the same model."""
    w, m, v = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)
    if len(y) == 0:
        return w[:-1], 0.0
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for t in range(1, rounds + 1):
        error = sigmoid(product(w[:-1]) + w[-1]) - y
        g = np.append(transposed(error) / len(y) + ridge * w[:-1], error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])
