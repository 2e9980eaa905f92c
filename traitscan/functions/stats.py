"""Distribution tails as functions of columns, and their quantiles on the driver."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _ln_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    g = np.vectorize(math.lgamma, otypes=[float])
    return g(a) + g(b) - g(a + b)


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    keep = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / keep(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / keep(1.0 + num * d)
            c = keep(1.0 + num / c)
            h *= c * d
        if np.all(np.abs(c * d - 1.0) < 1e-15):
            break
    return h


def ln_inc_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the regularised incomplete beta function I_x(a, b); deep tails keep their precision."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    out = np.full(x.shape, -np.inf)
    out[x >= 1] = 0.0
    mid = (x > 0) & (x < 1)
    x, a, b = x[mid], a[mid], b[mid]
    front = a * np.log(x) + b * np.log1p(-x) - _ln_beta(a, b)
    direct = x < (a + 1) / (a + b + 2)
    res = np.empty_like(x)
    res[direct] = front[direct] - np.log(a[direct]) + np.log(_fraction(x[direct], a[direct], b[direct]))
    f = ~direct
    res[f] = np.log1p(-np.exp(np.minimum(front[f] - np.log(b[f]) + np.log(_fraction(1 - x[f], b[f], a[f])), 0.0)))
    out[mid] = res
    return out


@F.pandas_udf(DoubleType())
def log10_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """log10 of the two-sided p-value of Student's t."""
    t2, v = t.to_numpy(float) ** 2, df.to_numpy(float)
    ok = ~np.isnan(t2) & ~np.isnan(v)
    out = np.full(len(t2), np.nan)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.where(np.isinf(t2), 0.0, v / (v + t2))
    out[ok] = ln_inc_beta(x[ok], v[ok] / 2, np.full(ok.sum(), 0.5)) / math.log(10)
    return pd.Series(out).where(ok)


@F.pandas_udf(DoubleType())
def log10_f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """log10 of the upper tail of the F distribution."""
    x, a, b = (s.to_numpy(float) for s in (f, d1, d2))
    return pd.Series(ln_inc_beta(b / (b + a * np.maximum(x, 0)), b / 2, a / 2) / math.log(10))


def t_quantile(p: float, df: float) -> float:
    """The t whose upper tail is p (0 < p < 0.5)."""
    tail = lambda t: float(ln_inc_beta(np.array([df / (df + t * t)]), np.array([df / 2]), np.array([0.5]))[0]) - math.log(2)
    lo, hi = 0.0, 1.0
    while tail(hi) > math.log(p):
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > math.log(p) else (lo, mid)
    return (lo + hi) / 2


def rsq_of_p(p: float, dfe: int, df_offset: int = 0) -> float:
    """The R² at which the two-sided p-value is p."""
    t = t_quantile(p / 2, dfe - df_offset)
    return t * t / (dfe + t * t)


def normal_cdf(x: F.Column) -> F.Column:
    """Standard normal distribution function, to about 1e-7, as a native expression."""
    k = 1 / (1 + 0.2316419 * F.abs(x))
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)
