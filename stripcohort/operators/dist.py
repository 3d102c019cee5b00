"""Distribution functions for the few rows that a test ends in, as small numpy-free helpers."""

from __future__ import annotations

import math


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15 and i:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return 0.0 if math.isinf(t) else _beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """t with P(T <= t) = p, for p >= 0.5; by halving."""
    lo, hi = 0.0, 1.0
    while 1 - t_two_sided(hi, df) / 2 < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def normal_cdf(x: float) -> float:
    return math.erfc(-x / math.sqrt(2)) / 2


def chi2_sf(x: float, df: int) -> float:
    """P(X >= x) for whole degrees of freedom, by its finite sum."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= x / 2 / i
            total += term
        return math.exp(-x / 2) * total
    total, term = math.erfc(math.sqrt(x / 2)), math.exp(-x / 2) * math.sqrt(2 * x / math.pi)
    for i in range(1, (df + 1) // 2):
        total += term
        term *= x / (2 * i + 1)
    return total


def f_sf(x: float, d1: float, d2: float) -> float:
    """P(F >= x)."""
    return 1.0 if x <= 0 else 0.0 if math.isinf(x) else _beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def range_quantile(p: float, k: int) -> float:
    """The p quantile of the range of k standard normals (the studentised range with infinite degrees of freedom), by halving."""

    def cdf(q: float) -> float:
        n, lo, hi = 400, -8.0, 8.0 + q
        h = (hi - lo) / n
        total = 0.0
        for i in range(n + 1):  # Simpson's rule
            z = lo + i * h
            value = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (normal_cdf(z) - normal_cdf(z - q)) ** (k - 1)
            total += value * (1 if i in (0, n) else 4 if i % 2 else 2)
        return k * total * h / 3

    lo, hi = 0.0, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2
