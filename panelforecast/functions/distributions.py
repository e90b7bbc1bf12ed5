"""Tails of the t and F distributions, for the few numbers of a fit's summary."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    top, low = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value = low
    for step in range(1, 10_000):  # the fraction's terms in pairs, until they change nothing
        even = step * (b - step) * x / ((a + 2 * step - 1) * (a + 2 * step))
        odd = -(a + step) * (a + b + step) * x / ((a + 2 * step) * (a + 2 * step + 1))
        for term in (even, odd):
            low = 1 / (1 + term * low)
            top = 1 + term / top
            ratio = top * low
            value *= ratio
        if abs(ratio - 1) < 1e-15:
            break
    return front * value


def f_tail(value: float, df1: float, df2: float) -> float:
    """The probability of an F statistic of at least ``value``."""
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * value)) if value > 0 else 1.0


def t_quantile(level: float, df: float) -> float:
    """The value that a t variable exceeds in size with probability ``1 - level``, by halving."""
    low, high = 0.0, 1.0
    while f_tail(high * high, 1, df) > 1 - level:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if f_tail(middle * middle, 1, df) > 1 - level else (low, middle)
    return high
