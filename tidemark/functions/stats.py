"""Small statistics that Spark has no function for, on driver-side numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_p_value(t: float, df: float) -> float:
    """Two-sided probability of a t statistic."""
    return 1.0 if df <= 0 else beta_inc(df / 2, 0.5, df / (df + t * t))


def correlation_p_value(r: float, n: int) -> float:
    if n < 3:
        return 1.0
    return 0.0 if abs(r) >= 1 else t_p_value(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def benjamini_hochberg(p: Sequence[float]) -> list[float]:
    """Adjusted p values, in the order given."""
    order, least, out = sorted(range(len(p)), key=lambda i: p[i]), 1.0, [0.0] * len(p)
    for rank in range(len(p), 0, -1):
        i = order[rank - 1]
        least = min(least, p[i] * len(p) / rank)
        out[i] = least
    return out


def t_test(n1: int, mean1: float, var1: float, n2: int, mean2: float, var2: float) -> tuple[float, float]:
    """Independent t test with pooled sample variance: statistic and two-sided probability."""
    df = n1 + n2 - 2
    pooled = ((n1 - 1) * var1 + (n2 - 1) * var2) / df
    t = (mean1 - mean2) / math.sqrt(pooled * (1 / n1 + 1 / n2))
    return t, t_p_value(t, df)
