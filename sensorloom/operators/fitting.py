"""Small solvers for the driver: ridge solution of summed normal equations and bounded least squares."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame


def solve(equations: DataFrame, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Coefficients and residual sum of squares from rows (i, j, value): a few numbers, whatever was summed."""
    rows = equations.collect()
    n = 1 + max(r["i"] for r in rows)
    a, b, yy = np.zeros((n, n)), np.zeros(n), 0.0
    for r in rows:
        i, j, v = r["i"], r["j"], float(r["value"] or 0.0)
        if i < 0:
            yy = v
        elif j < 0:
            b[i] = v
        else:
            a[i, j] = a[j, i] = v
    x = np.linalg.solve(a + ridge * np.eye(n), b)
    return x, float(yy - 2 * x @ b + x @ a @ x)


def least_squares(residual: Callable[[np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 100) -> np.ndarray:
    """Levenberg-Marquardt within bounds; derivatives by differences."""
    x = np.clip(np.asarray(start, float), low, high)
    damp, r = 1e-3, residual(x)
    for _ in range(steps):
        jac = np.empty((len(r), len(x)))
        for k in range(len(x)):
            h = 1e-6 * max(1.0, abs(x[k]))
            y = x.copy()
            y[k] += h if x[k] + h <= high[k] else -h
            jac[:, k] = (residual(y) - r) / (y[k] - x[k])
        g, hess = jac.T @ r, jac.T @ jac
        for _ in range(20):
            y = np.clip(x - np.linalg.solve(hess + damp * np.diag(np.maximum(np.diag(hess), 1e-12)), g), low, high)
            s = residual(y)
            if s @ s < r @ r:
                break
            damp *= 4
        else:
            return x
        small = np.abs(y - x).max() < 1e-10
        x, r, damp = y, s, max(damp / 4, 1e-12)
        if small:
            return x
    return x
