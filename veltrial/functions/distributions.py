"""Distribution functions as Arrow-batched column functions over numpy arrays.

They are meant for result rows (experiments x arms x looks), after aggregation.
NULL in gives NULL out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def log_gamma(a: np.ndarray) -> np.ndarray:
    """By Stirling's series past 12, where it is exact to the last digit, and the recurrence below."""
    a = np.asarray(a, float)
    shift = np.zeros_like(a)
    for _ in range(12):
        low = a < 12
        shift = shift + np.where(low, np.log(np.where(low, a, 1.0)), 0.0)
        a = np.where(low, a + 1, a)
    r = 1 / (a * a)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / a
    return (a - 0.5) * np.log(a) - a + 0.5 * np.log(2 * np.pi) + series - shift


def _floor(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) > _TINY, x, _TINY)


def beta_regularised(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Incomplete beta function by its continued fraction, on the side where that converges fast."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(x, 0.0, 1.0))
    flip = x >= (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    c = np.ones_like(z)
    d = 1 / _floor(1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 400):
        before = h
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / _floor(1 + num * d)
            c = _floor(1 + num / c)
            h = h * d * c
        if np.all(np.abs(h - before) <= 1e-15 * np.abs(h)):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p * h
    front = np.where(z <= 0, 0.0, front)
    return np.where(flip, 1 - front, front)


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0.0))
    small = x < a + 1
    xs, xl = np.where(small, x, 0.0), np.where(small, a + 2, x)
    term = total = 1 / a
    for k in range(1, 2000):
        term = term * xs / (a + k)
        total = total + term
        if np.all(term <= total * 1e-17):
            break
    b = xl + 1 - a
    c, d = np.full_like(b, 1 / _TINY), 1 / b
    h = d.copy()
    for i in range(1, 2000):
        b = b + 2
        d = 1 / _floor(-i * (i - a) * d + b)
        c = _floor(b - i * (i - a) / c)
        before, h = h, h * d * c
        if np.all(np.abs(h - before) <= 1e-15 * np.abs(h)):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(-x + a * np.log(x) - log_gamma(a))
    return np.where(x <= 0, 1.0, np.where(small, np.maximum(0.0, 1 - front * total), front * h))


def _normal_sf(x: np.ndarray) -> np.ndarray:
    tail = 0.5 * gamma_upper(0.5, x * x / 2)
    return np.where(x >= 0, tail, 1 - tail)


def _t_sf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    finite = np.where(np.isinf(df), 1.0, df)
    tail = np.where(np.isinf(df), _normal_sf(np.abs(t)), 0.5 * beta_regularised(finite / 2, 0.5, finite / (finite + t * t)))
    return np.where(t >= 0, tail, 1 - tail)


def _quantile(sf: Callable[[np.ndarray], np.ndarray], p: np.ndarray) -> np.ndarray:
    """Of a distribution around 0, by bisection on its tail."""
    tail = np.minimum(p, 1 - p)
    lo, hi = np.zeros_like(tail), np.full_like(tail, 2.0)
    while np.any(far := sf(hi) > tail) and hi.max() < 1e12:
        hi = np.where(far, 2 * hi, hi)
    for _ in range(80):
        mid = 0.5 * (lo + hi)
        above = sf(mid) > tail
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(p < 0.5, -1, 1) * 0.5 * (lo + hi)


def _of_known(fn: Callable[..., np.ndarray], *series: pd.Series) -> pd.Series:
    values = [s.to_numpy(float) for s in series]
    known = ~np.any(np.isnan(values), axis=0)
    out = np.full(len(known), np.nan)
    if known.any():
        out[known] = fn(*(v[known] for v in values))
    return pd.Series(out).where(known)


def _one(fn: Callable[[np.ndarray], np.ndarray], a: Column) -> Column:
    def batch(a: pd.Series) -> pd.Series:
        return _of_known(fn, a)

    return F.pandas_udf(batch, "double")(a.cast("double"))


def _two(fn: Callable[[np.ndarray, np.ndarray], np.ndarray], a: Column, b: Column) -> Column:
    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return _of_known(fn, a, b)

    return F.pandas_udf(batch, "double")(a.cast("double"), b.cast("double"))


def normal_cdf(x: Column) -> Column:
    return _one(lambda x: _normal_sf(-x), x)


def normal_ppf(p: Column) -> Column:
    return _one(lambda p: _quantile(_normal_sf, p), p)


def normal_two_sided(z: Column) -> Column:
    return _one(lambda z: 2 * _normal_sf(np.abs(z)), z)


def t_two_sided(t: Column, df: Column) -> Column:
    return _two(lambda t, df: 2 * _t_sf(np.abs(t), df), t, df)


def t_ppf(p: Column, df: Column) -> Column:
    return _two(lambda p, df: _quantile(lambda t: _t_sf(t, df), p), p, df)


def chi2_sf(x: Column, df: Column) -> Column:
    return _two(lambda x, df: gamma_upper(df / 2, x / 2), x, df)
