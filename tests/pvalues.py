"""Tail probabilities of one-row test statistics, without external numerics.

Only the final scalars of a test come here; the statistics are computed by Spark.
"""

from __future__ import annotations

import math


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, else continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def beta_regularised(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularised(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + even * d) or tiny)
        c = (1 + even / c) or tiny
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + odd * d) or tiny)
        c = (1 + odd / c) or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h / a


def chi2_tail(stat: float, dof: float) -> float:
    return gamma_upper(dof / 2, stat / 2)


def normal_two_sided(z: float) -> float:
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def normal_upper_doubled(z: float) -> float:
    """Twice the upper tail, capped at one (a statistic on the wrong side gives one)."""
    return min(1.0, math.erfc(z / math.sqrt(2)))


def correlation_two_sided(rho: float, n: float) -> float:
    """Student-t p-value of a correlation with n - 2 degrees of freedom."""
    dof = n - 2
    if dof <= 0:
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * dof / (1 - rho * rho)
    return beta_regularised(dof / 2, 0.5, dof / (dof + t2))


TAILS = {
    "chi2": chi2_tail,
    "normal": lambda z, _: normal_upper_doubled(z),
    "correlation": correlation_two_sided,
}


def tail(kind: str, stat: float | None, extra: float | None) -> float | None:
    if stat is None or math.isnan(stat):
        return None
    return TAILS[kind](stat, extra if extra is not None else 0.0)
