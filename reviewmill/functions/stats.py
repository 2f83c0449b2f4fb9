"""Tail probabilities for a handful of aggregated rows: Student t, chi-square, normal, Kolmogorov (Spark has none)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated front to back (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value


def _regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def t_upper_tail(t: float, df: float) -> float:
    """P(T > t) for Student's t with ``df`` degrees of freedom."""
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    half = 0.5 * _regularised_beta(df / 2.0, 0.5, df / (df + t * t))
    return half if t >= 0 else 1.0 - half


@F.pandas_udf(T.DoubleType())
def t_upper_tail_column(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) or pd.isna(b) else t_upper_tail(float(a), float(b)) for a, b in zip(t, df)],
        dtype="float64",
    )


def chi_square_upper_tail(x: float, df: int) -> float:
    """P(X > x) for chi-square with a whole number of degrees of freedom, by recurrence over them."""
    if math.isnan(x) or df <= 0:
        return math.nan
    if math.isinf(x):
        return 0.0
    half = x / 2.0
    if half <= 0:
        return 1.0
    order, tail = (0.5, math.erfc(math.sqrt(half))) if df % 2 else (1.0, math.exp(-half))
    while order < df / 2.0:
        tail += math.exp(order * math.log(half) - half - math.lgamma(order + 1.0))
        order += 1.0
    return min(1.0, tail)


def normal_two_sided(z: float) -> float:
    """P(|Z| > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def kolmogorov_upper_tail(x: float) -> float:
    """P(K > x) for the limit distribution of the Kolmogorov statistic. Small x by the series that is quick there."""
    if x <= 0:
        return 1.0
    if x < 1.18:
        terms = (math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 20))
        return max(0.0, 1.0 - math.sqrt(2 * math.pi) / x * sum(terms))
    return 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
