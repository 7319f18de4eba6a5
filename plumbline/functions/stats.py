"""Test statistics from sums, and p-values of Student's t and Fisher's F."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def welch(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> tuple[Column, Column]:
    """(t, degrees of freedom) from sizes, means and sample variances; null where both variances are 0."""
    a, b = v1 / n1, v2 / n2
    t = F.try_divide(m1 - m2, F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), a * a / F.greatest(n1 - 1, F.lit(1)) + b * b / F.greatest(n2 - 1, F.lit(1)))
    return t, df


def student(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> tuple[Column, Column]:
    """(t, degrees of freedom) with pooled variance."""
    df = n1 + n2 - 2
    pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, df)
    return F.try_divide(m1 - m2, F.sqrt(pooled * (1 / n1 + 1 / n2))), df


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return _beta_share(df / 2, 0.5, df / (df + t * t))


def f_p(f: float, df1: float, df2: float) -> float:
    """Upper p-value of Fisher's F."""
    return _beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_p(x, d) if x == x and d == d and d > 0 else None for x, d in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([f_p(x, a, b) if x == x and a > 0 and b > 0 else None for x, a, b in zip(f, df1, df2, strict=True)], dtype="float64")
