"""Tail fits and significance without a statistics library."""

from __future__ import annotations

import math

import numpy as np


def weibull_fit(x: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Maximum-likelihood shape and scale (origin 0), by bisection on the shape."""
    x = np.maximum(np.asarray(x, float), 1e-12)
    logs = np.log(x)
    if len(x) < 2 or logs.max() - logs.min() < 1e-12:
        return 1.0, float(x.mean()) if len(x) else 1.0
    unit, top = logs - logs.max(), logs.max()

    def slope(shape: float) -> float:
        w = np.exp(shape * unit)
        return float((w * unit).sum() / w.sum() - 1 / shape - unit.mean())

    low, high = 1e-3, 1.0
    while slope(high) < 0 and high < 1e6:
        high *= 2
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) < 0 else (low, mid)
    shape = (low + high) / 2
    return shape, float(np.exp(top) * np.mean(np.exp(shape * unit)) ** (1 / shape))


def pareto_fit(excess: np.ndarray) -> tuple[float, float]:
    """Maximum-likelihood shape and scale of the generalised Pareto law (origin
    0), by the profile likelihood in theta = shape / scale."""
    x = np.asarray(excess, float)
    x = x[x >= 0]
    if len(x) < 2 or x.max() <= 0:
        return 0.0, float(max(x.mean(), 1e-12)) if len(x) else 1e-12
    mean, top = x.mean(), x.max()
    grid = np.concatenate([-np.geomspace(1e-6, 0.999, 200)[::-1] / top, np.geomspace(1e-6, 50, 200) / mean])

    def profile(theta: float) -> float:
        shape = np.log1p(theta * x).mean()
        if abs(theta) < 1e-12 or shape / theta <= 0:
            return -math.inf
        return -len(x) * (math.log(shape / theta) + shape + 1)

    values = np.array([profile(t) for t in grid])
    k = int(values.argmax())
    low, high = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    gold = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = high - gold * (high - low), low + gold * (high - low)
        low, high = (low, b) if profile(a) >= profile(b) else (a, high)
    theta = (low + high) / 2
    exponential = -len(x) * (math.log(mean) + 1)
    if not math.isfinite(profile(theta)) or profile(theta) < exponential:
        return 0.0, float(mean)
    shape = float(np.log1p(theta * x).mean())
    return shape, shape / theta


def pareto_quantile(p: float, shape: float, scale: float) -> float:
    return -scale * math.log1p(-p) if abs(shape) < 1e-9 else scale / shape * ((1 - p) ** -shape - 1)


def student_two_sided(t: float, df: int) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the
    incomplete beta function."""
    if not math.isfinite(t):
        return 0.0
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def paired_t(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """t and two-sided p of paired samples."""
    d = np.asarray(a, float) - np.asarray(b, float)
    if len(d) < 2:
        return math.nan, math.nan
    spread = d.std(ddof=1)
    if spread == 0:
        return (math.inf if d.mean() else 0.0), (0.0 if d.mean() else 1.0)
    t = d.mean() / (spread / math.sqrt(len(d)))
    return float(t), student_two_sided(float(t), len(d) - 1)


def wilcoxon(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sided p of the signed-rank test: exact over all signs up to 50 pairs
    without ties, else by the normal law with tie correction; equal pairs drop."""
    d = np.asarray(a, float) - np.asarray(b, float)
    d = d[d != 0]
    n = len(d)
    if not n:
        return 1.0
    values, at, counts = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[at]
    low = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    if n <= 50 and len(values) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48)
    return float(math.erfc(abs(low - n * (n + 1) / 4) / spread / math.sqrt(2)))
