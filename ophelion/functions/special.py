"""Tails of distributions on numpy, for p-values of small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # series for the lower part
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    tiny = 1e-300  # continued fraction by Lentz's method
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def beta_regular(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regular(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + an * d or tiny)
            c = 1 + an / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_tail(x: float, dof: float) -> float:
    return gamma_upper(dof / 2, x / 2)


def t_tail(t: float, dof: float) -> float:
    """Two-sided tail of Student's t."""
    return 1.0 if dof <= 0 else beta_regular(dof / 2, 0.5, dof / (dof + t * t))


def studentised_range_tail(q: float, k: int) -> float:
    """P(range of k standard normals > q): infinite degrees of freedom."""
    if q <= 0:
        return 1.0
    z = np.linspace(-8, 8, 4001)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    shifted = np.array([0.5 * math.erfc(-(v - q) / math.sqrt(2)) for v in z])
    return float(max(0.0, 1 - np.trapezoid(k * density * (cdf - shifted) ** (k - 1), z)))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(d) or d <= 0 else chi2_tail(a, d) for a, d in zip(x, dof, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation from n pairs."""

    def one(r, n):
        if pd.isna(r) or n < 3:
            return None
        if abs(r) >= 1:
            return 0.0
        return t_tail(r * math.sqrt((n - 2) / ((1 - r) * (1 + r))), n - 2)

    return pd.Series([one(a, b) for a, b in zip(r, n, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def range_p(q: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([studentised_range_tail(a, int(b)) for a, b in zip(q, k, strict=True)], dtype="float64")
