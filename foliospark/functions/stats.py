"""The risk-parity solver."""

from __future__ import annotations

from math import sqrt

import numpy as np


def risk_parity(cov: np.ndarray, sweeps: int = 200, tol: float = 1e-12) -> np.ndarray:
    """Weights of equal risk contribution by cyclical coordinate descent (Spinu 2013; Griveau-Billion, Richard
    and Roncalli 2013)."""
    n = len(cov)
    if n <= 1:
        return np.ones(n)
    s = (cov + cov.T) / 2 + 1e-8 * np.eye(n)
    if not np.isfinite(s).all() or (np.diag(s) <= 0).any():
        return np.full(n, 1 / n)
    y = 1 / np.sqrt(np.diag(s))
    for _ in range(sweeps):
        before = y.copy()
        for i in range(n):
            b = s[i] @ y - s[i, i] * y[i]
            y[i] = (-b + sqrt(b * b + 4 * s[i, i])) / (2 * s[i, i])
        if np.abs(y - before).max() <= tol * np.abs(y).max():
            break
    w = np.clip(y / y.sum(), 0, None)
    return w / w.sum() if np.isfinite(w).all() and w.sum() > 0 else np.full(n, 1 / n)
