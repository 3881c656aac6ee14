"""Linear models for small bounded samples, fitted on the driver with numpy."""

from __future__ import annotations

import numpy as np


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights, the last one the bias, of an L2-regularised hinge-loss machine, by dual coordinate descent.

    ``x``: rows by features; ``y``: -1 or 1. Classes weigh alike, whatever their sizes.
    """
    n, d = x.shape
    w = np.zeros(d + 1, np.float64)
    if not n:
        return w
    norms = np.einsum("ij,ij->i", x, x) + 1.0
    share = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    alpha, rng = np.zeros(n), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(n):
            grad = y[i] * (x[i] @ w[:-1] + w[-1]) - 1
            new = min(max(alpha[i] - grad / norms[i], 0.0), c * share[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[:-1] += step * x[i]
                w[-1] += step
                alpha[i] = new
    return w


def sigmoid(z: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sparse_logistic(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, d: int, l1: float = 0.001, rounds: int = 150) -> np.ndarray:
    """L1-regularised logistic weights over binary features, by accelerated proximal gradient.

    ``rows``, ``cols``: the ones of the design, sorted by row; ``extra``: dense features of each row. Returns ``d``
    weights, then those of ``extra`` and the bias, neither of which is shrunk.
    """
    n, k = len(y), extra.shape[1]
    dense = np.concatenate([extra, np.ones((n, 1))], axis=1)
    w = np.zeros(d + k + 1)
    z, t = w.copy(), 1.0
    # a bound on the largest eigenvalue of the design's second moments
    per_row = np.bincount(rows, minlength=n) + (dense**2).sum(1)
    v = np.ones(d + k + 1)
    for _ in range(20):
        u = np.bincount(rows, v[cols], n) + dense @ v[d:]
        v = np.concatenate([np.bincount(cols, u[rows], d), dense.T @ u])
        big = np.linalg.norm(v)
        v /= max(big, 1e-12)
    step = 4 * n / max(min(big * 1.05, per_row.max() * n), 1e-12)
    for _ in range(rounds):
        p = sigmoid(np.bincount(rows, z[cols], n) + dense @ z[d:])
        r = (p - y) / n
        new = z - step * np.concatenate([np.bincount(cols, r[rows], d), dense.T @ r])
        new[:d] = np.sign(new[:d]) * np.maximum(np.abs(new[:d]) - step * l1, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w
