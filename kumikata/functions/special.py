"""Probabilities that Spark has no function for, in NumPy and the standard library."""

from __future__ import annotations

import math


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x), by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_p(statistic: float, freedom: int) -> float:
    """Chance of a chi-square as large."""
    return gamma_upper(freedom / 2, statistic / 2) if freedom > 0 else 1.0


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 500):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or tiny)
            c = 1 + n / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_quantile(p: float, a: float, b: float) -> float:
    """The x with I_x(a, b) = p, by halving."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if beta_cdf(mid, a, b) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2 x 2 table: all tables with these margins that are no likelier."""
    n, row, column = a + b + c + d, a + b, a + c
    log = lambda k: math.lgamma(row + 1) - math.lgamma(k + 1) - math.lgamma(row - k + 1) + math.lgamma(n - row + 1) - math.lgamma(column - k + 1) - math.lgamma(n - row - column + k + 1) - (math.lgamma(n + 1) - math.lgamma(column + 1) - math.lgamma(n - column + 1))
    seen = log(a)
    return min(1.0, sum(math.exp(log(k)) for k in range(max(0, row + column - n), min(row, column) + 1) if log(k) <= seen + 1e-7))
