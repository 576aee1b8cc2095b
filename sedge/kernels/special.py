"""Distribution functions and exact intervals, without a statistics library."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def beta_quantile(p: float, a: float, b: float) -> float:
    """By halving: the function grows."""
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if incomplete_beta(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def exact_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson bounds of a share of k in n."""
    tail = (1 - level) / 2
    return (0.0 if k == 0 else beta_quantile(tail, k, n - k + 1), 1.0 if k == n else beta_quantile(1 - tail, k + 1, n - k))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def student_two_sided(t: float, freedom: float) -> float:
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def reading(k: int, n: int, limit: float, level: float = 0.95) -> str:
    """Whether a share is above, within or not told apart from a limit."""
    lo, hi = exact_interval(k, n, level)
    return "above" if lo > limit else "within" if hi <= limit else "indistinguishable"
