"""Chi-square distribution function and quantiles (numpy and math only)."""

from __future__ import annotations

import math

import numpy as np


def cdf(x: float, dims: int) -> float:
    """Probability of at most x, by the series of the regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = dims / 2, x / 2
    if x > a + 60 * math.sqrt(a + 1) + 200:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def quantile(p: float, dims: int) -> float:
    """The value that is not exceeded with probability p, by bisection."""
    low, high = 0.0, 1.0
    while cdf(high, dims) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid, dims) < p else (low, mid)
    return (low + high) / 2


def cdf_of(x: np.ndarray, dims: int) -> np.ndarray:
    """The distribution function of many values, by interpolation in a fine table."""
    top = quantile(1 - 1e-12, dims)
    grid = np.linspace(0, top, 4096)
    return np.interp(x, grid, [cdf(float(g), dims) for g in grid])
