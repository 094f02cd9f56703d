"""Tail probabilities of test statistics as column functions: vectorised series and continued fractions over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, TINY = 500, 1e-300
lgamma = np.vectorize(math.lgamma, otypes=[float])


def gamma_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper regularised incomplete gamma function: a series below a + 1, a continued fraction above."""
    front = np.exp(-x + a * np.log(np.maximum(x, TINY)) - lgamma(a))
    term = total = 1 / a
    for k in range(1, ROUNDS):
        term = term * x / (a + k)
        total = total + term
        if (term < total * 1e-17).all():
            break
    b = x + 1 - a
    c, d = np.full_like(x, 1 / TINY), 1 / np.where(b == 0, TINY, b)
    h = d
    for k in range(1, ROUNDS):
        m = -k * (k - a)
        b = b + 2
        d = m * d + b
        d = 1 / np.where(np.abs(d) < TINY, TINY, d)
        c = b + m / c
        c = np.where(np.abs(c) < TINY, TINY, c)
        h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - front * total, front * h))


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, on the side where that converges fast."""
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = np.clip(x, TINY, 1 - 1e-16)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(inside) + b * np.log1p(-inside)) / a
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    h = d
    for m in range(1, ROUNDS):
        for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + part * d
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = 1 + part / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * h))
    return np.where(flip, 1 - out, out)


def _where_known(f, *args: pd.Series) -> pd.Series:
    known = np.logical_and.reduce([s.notna().to_numpy() & np.isfinite(s.to_numpy(dtype=float, na_value=np.nan)) for s in args])
    out = np.full(len(known), np.nan)
    if known.any():
        out[known] = f(*[s.to_numpy(dtype=float, na_value=np.nan)[known] for s in args])
    return pd.Series([None if np.isnan(v) else v for v in out], dtype="object")


def chi2_tail(statistic: Column, df: Column) -> Column:
    """P(X > statistic) of the chi-squared law; null where a statistic or df is missing or df is not positive."""

    @F.pandas_udf("double")
    def tail(h: pd.Series, k: pd.Series) -> pd.Series:
        return _where_known(lambda x, n: np.where(n > 0, gamma_tail(np.maximum(n, 1e-9) / 2, x / 2), np.nan), h, k)

    return tail(statistic.cast("double"), df.cast("double"))


def t_tail(t: Column, df: Column) -> Column:
    """P(|T| > |t|) of Student's law; null where t or df is missing or df is not positive."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, k: pd.Series) -> pd.Series:
        return _where_known(lambda x, n: np.where(n > 0, beta_share(np.maximum(n, 1e-9) / 2, np.full_like(x, 0.5), n / (n + x * x)), np.nan), t, k)

    return tail(t.cast("double"), df.cast("double"))
