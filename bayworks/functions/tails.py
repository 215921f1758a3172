"""Tail probabilities of test statistics as column expressions.

Incomplete gamma and beta functions are continued fractions (or a power series), folded over
a sequence whose length follows from the parameters. They serve the one-row results of tests;
a null or undefined statistic gives a null probability.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of a fraction: so many, and so many for each unit of the root of its first parameter.
STEPS, STEPS_PER_ROOT, MOST_STEPS = 200, 10, 200_000
_SHIFT = 10
_TINY = 1e-300


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series ten steps up, and back down."""
    y = x + _SHIFT
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    down = x
    for k in range(1, _SHIFT):
        down = down * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(down)


def _steps(parameter: Column) -> Column:
    wanted = F.ceil(STEPS + STEPS_PER_ROOT * F.sqrt(parameter))
    return F.sequence(F.lit(1), F.least(wanted, F.lit(MOST_STEPS)).cast("int"))


def _away(x: Column) -> Column:
    """``x``, kept away from zero as a divisor."""
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _lentz(steps: Column, first: Column, pairs: Callable[[Column], list[tuple[Column, Column]]]) -> Column:
    """Value of b0 + a1 / (b1 + a2 / ...) by Lentz's method; ``pairs(i)`` are the (a, b) of step i."""

    def state(h, c, d):
        return F.struct(h.cast("double").alias("h"), c.cast("double").alias("c"), d.cast("double").alias("d"))

    def step(s: Column, i: Column) -> Column:
        h, c, d = s["h"], s["c"], s["d"]
        for a, b in pairs(i.cast("double")):
            d = 1 / _away(a * d + b)
            c = _away(b + a / c)
            h = h * c * d
        return state(h, c, d)

    begin = _away(first)
    return F.aggregate(steps, state(begin, begin, F.lit(0.0)), step, lambda s: s["h"])


def gamma_tail(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for a > 0."""

    def tail(p: Column) -> Column:
        a, x = p["a"], p["x"]
        scale = F.exp(a * F.log(x) - x - log_gamma(a))
        zero = F.struct((1 / a).alias("term"), (1 / a).alias("total"))

        def add(s: Column, i: Column) -> Column:
            term = s["term"] * x / (a + i)
            return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

        below = F.aggregate(_steps(a), zero, add, lambda s: F.greatest(1 - s["total"] * scale, F.lit(0.0)))
        fraction = _lentz(_steps(a), x + 1 - a, lambda i: [(i * (a - i), x + 2 * i + 1 - a)])
        return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, below).otherwise(scale / fraction)

    return let(F.struct(a.cast("double").alias("a"), x.cast("double").alias("x")), lambda p: F.when((p["a"] > 0) & p["x"].isNotNull(), tail(p)))


def _beta_fraction(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """I_x(a, b) where its fraction converges fast; ``rest`` is 1 - x."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(rest)) / a
    one = F.lit(1.0)

    def pairs(i: Column) -> list[tuple[Column, Column]]:
        m = i - 1  # odd terms start at m = 0, even ones at m = 1
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i))
        return [(odd, one), (even, one)]

    return front / _lentz(_steps(a + b), one, pairs)


def beta_part(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b); ``rest`` is 1 - x, given so that it keeps its digits."""

    def part(p: Column) -> Column:
        a, b, x, rest = (p[k] for k in ("a", "b", "x", "rest"))
        mirrored = x > (a + 1) / (a + b + 2)
        inner = F.when(mirrored, 1 - _beta_fraction(b, a, rest, x)).otherwise(_beta_fraction(a, b, x, rest))
        return F.when(x <= 0, F.lit(0.0)).when(rest <= 0, F.lit(1.0)).otherwise(inner)

    whole = F.struct(*(c.cast("double").alias(k) for k, c in (("a", a), ("b", b), ("x", x), ("rest", rest))))
    known = lambda p: (p["a"] > 0) & (p["b"] > 0) & p["x"].isNotNull()
    return let(whole, lambda p: F.when(known(p), part(p)))


def chi2_tail(stat: Column, dof: Column) -> Column:
    """Chance of a chi-square value of ``stat`` or more; null without a degree of freedom."""
    return gamma_tail(dof / 2, stat / 2)


def normal_upper_doubled(z: Column) -> Column:
    """Twice the upper tail of the normal distribution, one at most."""
    return F.when(z <= 0, F.lit(1.0)).when(z > 0, gamma_tail(F.lit(0.5), z * z / 2))


def correlation_two_sided(rho: Column, n: Column) -> Column:
    """Chance of a correlation of this size or more among n pairs, by Student's t with n - 2 degrees
    of freedom; null for fewer than three pairs."""
    free, rest = (n - 2).cast("double"), 1 - rho * rho
    # rho^2 n / (rest + rho^2) of the t value: x = free / (free + t^2) is just 1 - rho^2.
    return F.when((free > 0) & rho.isNotNull(), F.when(rest <= 0, F.lit(0.0)).otherwise(beta_part(free / 2, F.lit(0.5), rest, rho * rho)))
