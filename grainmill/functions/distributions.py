"""Tail probabilities of the t and F distributions (pandas UDFs over already aggregated rows)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for step in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    value = np.where(z <= 0, 0.0, front * h)
    return np.where(swap, 1 - value, value)


def _safe(func, *columns: pd.Series) -> pd.Series:
    frame = pd.concat([pd.Series(c).astype(float).reset_index(drop=True) for c in columns], axis=1)
    good = frame.notna().all(axis=1) & np.isfinite(frame).all(axis=1)
    out = pd.Series(np.nan, index=frame.index)
    if good.any():
        out[good] = func(*[frame.loc[good].iloc[:, i].to_numpy() for i in range(frame.shape[1])])
    return out


def _t_tail(t, df):
    return incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def _f_tail(f, d1, d2):
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic."""
    return _safe(_t_tail, t, df)


@F.pandas_udf(T.DoubleType())
def f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper-tail p-value of an F statistic."""
    return _safe(_f_tail, f, d1, d2)
