"""Student-t tail probability and critical value for batches of test rows.

Spark has no t distribution, so these are two vectorized pandas UDFs applied to
one row per test (after aggregation), never to observations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.atleast_1d(x)])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta integral (modified Lentz steps)."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    value = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        value = value * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        step = d * c
        value = value * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return value


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for T with df degrees of freedom."""
    t = np.asarray(t, dtype=float)
    df = np.asarray(df, dtype=float)
    x = df / (df + t * t)
    a, b = df / 2.0, np.full_like(df, 0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
            + a * np.log(x) + b * np.log1p(-np.minimum(x, 1.0 - 1e-16))
        )
        direct = front * _beta_fraction(a, b, x) / a
        mirrored = 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    p = np.where(x < (a + 1.0) / (a + b + 2.0), direct, mirrored)
    return np.clip(np.where(t == 0.0, 1.0, p), 0.0, 1.0)


def critical_value(confidence: float, df: np.ndarray) -> np.ndarray:
    """Two-sided critical value by bisection on the tail probability."""
    df = np.asarray(df, dtype=float)
    target = 1.0 - confidence
    low, high = np.zeros_like(df), np.full_like(df, 1.0)
    while np.any(two_sided_p(high, df) > target):
        high = np.where(two_sided_p(high, df) > target, high * 2.0, high)
    for _ in range(200):
        middle = (low + high) / 2.0
        above = two_sided_p(middle, df) > target
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2.0


@F.pandas_udf(T.DoubleType())
def t_p_value(statistic: pd.Series, df: pd.Series) -> pd.Series:
    known = statistic.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=statistic.index, dtype="float64")
    if known.any():
        out[known] = two_sided_p(
            statistic[known].to_numpy(dtype=float), df[known].to_numpy(dtype=float)
        )
    return out.astype(object).where(out.notna(), None)


@F.pandas_udf(T.DoubleType())
def t_critical(confidence: pd.Series, df: pd.Series) -> pd.Series:
    known = df.notna() & (df > 0)
    out = pd.Series(np.nan, index=df.index, dtype="float64")
    if known.any():
        # Distinct degrees of freedom only: a batch of tests usually shares few.
        frame = pd.DataFrame({"c": confidence[known], "d": df[known].astype(float)})
        pairs = frame.drop_duplicates()
        values = {
            (c, d): float(critical_value(c, np.array([d]))[0])
            for c, d in pairs.itertuples(index=False)
        }
        out[known] = [values[pair] for pair in frame.itertuples(index=False, name=None)]
    return out.astype(object).where(out.notna(), None)
