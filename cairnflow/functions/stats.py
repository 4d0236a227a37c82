"""Numbers the driver needs: Student's t quantile and the two-sample Kolmogorov-Smirnov p-value."""

from __future__ import annotations

import math
from functools import lru_cache


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@lru_cache(maxsize=4096)
def t_quantile(q: float, df: float) -> float:
    """Quantile of Student's t distribution."""
    if not 0 < q < 1 or df <= 0:
        raise ValueError("needs 0 < q < 1 and df > 0")
    if q < 0.5:
        return -t_quantile(1 - q, df)
    cdf = lambda t: 1 - 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    lo, hi = 0.0, 1.0
    while cdf(hi) < q:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < q else (lo, mid)
    return (lo + hi) / 2


def ks_pvalue(d: float, n1: int, n2: int, exact_up_to: int = 10_000) -> float:
    """Two-sided p-value of the two-sample statistic: exact where neither sample has more than so many records, else asymptotic."""
    if n1 <= 0 or n2 <= 0:
        raise ValueError("both samples need records")
    if d <= 0:
        return 1.0
    if max(n1, n2) <= exact_up_to:
        return _ks_exact(d, n1, n2)
    lam = d * math.sqrt(n1 * n2 / (n1 + n2))
    if lam < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))


def _ks_exact(d: float, n1: int, n2: int) -> float:
    """One less the share of lattice paths from (0, 0) to (n1, n2) that stay closer than d to the diagonal.

    Paths go step by step, all places reached by so many steps at once; weights are kept as probabilities: a path goes up or
    right in proportion to what is left. Only places near enough to the diagonal are looked at.
    """
    import numpy as np

    total = n1 + n2
    edge = d * n1 * n2 - 1e-9 * n1 * n2
    at = np.zeros(n1 + 2)  # by the place i of n1, one further on, so that place -1 is 0
    at[1] = 1.0 if edge > 0 else 0.0
    for s in range(1, total + 1):
        near = math.ceil((s * n1 - edge) / total), math.floor((s * n1 + edge) / total)
        lo, hi = max(0, s - n2, near[0]), min(n1, s, near[1])
        if lo > hi:
            return 1.0
        i = np.arange(lo, hi + 1)
        new = (at[lo : hi + 1] * (n1 - i + 1) + at[lo + 1 : hi + 2] * (n2 - (s - i) + 1)) / (total - s + 1)
        new[np.abs(i * total - s * n1) >= edge] = 0.0
        at[max(0, lo - 1) : min(n1, hi + 1) + 2] = 0.0  # the band moves on by at most one place
        at[lo + 1 : hi + 2] = new
    return float(min(1.0, max(0.0, 1.0 - at[n1 + 1])))


def register(spark) -> None:
    """SQL functions t_quantile(q, df) and ks_pvalue(d, n1, n2)."""
    spark.udf.register("t_quantile", lambda q, df: None if q is None or df is None else t_quantile(float(q), float(df)), "double")
    spark.udf.register("ks_pvalue", lambda d, n1, n2: None if None in (d, n1, n2) else ks_pvalue(float(d), int(n1), int(n2)), "double")
