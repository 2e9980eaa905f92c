"""Local false discovery rates: normal quantiles, kernel density, a smoothing spline.

Rows are only counted: Spark puts the probit of each p-value into one of CELLS
cells of a fixed range, linearly shared between neighbours, and the curve is made
from these counts on the driver. It is the null density over the smoothed density,
not falling with p, as a table over the same cells.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: p-values are kept this far from 0 and 1.
EPS = 1e-8
CELLS = 8192
#: Points of the density curve, and the bandwidth's factor.
POINTS, ADJUST = 512, 1.5

_quantile = np.frompyfunc(NormalDist().inv_cdf, 1, 1)
EDGE = -NormalDist().inv_cdf(EPS)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Probits of p-values, kept EPS away from 0 and 1; NaN stays."""
    p = np.asarray(p, float)
    out = np.full(p.shape, np.nan)
    ok = ~np.isnan(p)
    out[ok] = _quantile(np.clip(p[ok], EPS, 1 - EPS)).astype(float)
    return out


@F.pandas_udf(DoubleType())
def probit(p):  # noqa: ANN001, ANN201
    """normal_quantile of a column; NULL stays NULL."""
    import pandas as pd

    return pd.Series(normal_quantile(p.to_numpy(float))).where(p.notna().to_numpy())


def normal_density(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def cell_place(name: str) -> Column:
    """Place of a probit among the cells, from 0 to CELLS; NULL for none."""
    x = F.col(name)
    held = (F.least(F.greatest(x, F.lit(-EDGE)), F.lit(EDGE)) + EDGE) / (2 * EDGE) * CELLS
    return F.when(x.isNotNull() & ~F.isnan(x), held)


def probit_counts(df: DataFrame, names: list[str]) -> np.ndarray:
    """For each column of probits its weight at the CELLS + 1 grid points."""
    x = F.posexplode(F.array(*map(cell_place, names)))
    places = df.select(x.alias("k", "x")).where("x is not null").withColumn("c", F.floor("x"))
    ends = F.explode(F.array(F.struct(F.col("c"), (1 - (F.col("x") - F.col("c"))).alias("w")), F.struct((F.col("c") + 1).alias("c"), (F.col("x") - F.col("c")).alias("w"))))
    found = places.select("k", ends.alias("e")).groupBy("k", "e.c").agg(F.sum("e.w").alias("w"))
    out = np.zeros((len(names), CELLS + 2))
    for r in found.collect():  # CELLS + 2 rows a column at most
        out[r.k, r.c] += r.w
    return out[:, : CELLS + 1]


def grid() -> np.ndarray:
    return np.linspace(-EDGE, EDGE, CELLS + 1)


def bandwidth(x: np.ndarray, w: np.ndarray) -> float:
    """Silverman's rule of thumb of weighted points."""
    n = w.sum()
    mean = (w * x).sum() / n
    sd = math.sqrt(max((w * (x - mean) ** 2).sum() / max(n - 1, 1), 0))
    q1, q3 = np.interp([0.25 * n, 0.75 * n], np.cumsum(w), x)
    low = min(sd, (q3 - q1) / 1.34) or sd or 1.0
    return 0.9 * low * n**-0.2


def kernel_density(x: np.ndarray, w: np.ndarray, adjust: float = ADJUST, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian kernel density of weighted points on equal steps, three bandwidths beyond the data."""
    x, w = x[w > 0], w[w > 0]
    h = adjust * bandwidth(x, w)
    at = np.linspace(x[0] - 3 * h, x[-1] + 3 * h, points)
    out = np.zeros(points)
    for lo in range(0, len(x), 1024):
        out += normal_density((at[:, None] - x[lo : lo + 1024]) / h) @ w[lo : lo + 1024]
    return at, out / (h * w.sum())


def banded_solve(bands: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A x = y for a symmetric positive matrix with bands[k] on its k-th diagonal, by its LDL' factors."""
    m, n = bands.shape[0] - 1, bands.shape[1]
    d, low, x = np.zeros(n), np.zeros((m + 1, n)), y.astype(float).copy()
    for i in range(n):
        d[i] = bands[0, i] - sum(low[k, i - k] ** 2 * d[i - k] for k in range(1, min(m, i) + 1))
        for k in range(1, min(m, n - 1 - i) + 1):
            low[k, i] = (bands[k, i] - sum(low[j, i - j] * low[j + k, i - j] * d[i - j] for j in range(1, min(m - k, i) + 1))) / d[i]
        x[i] -= sum(low[k, i - k] * x[i - k] for k in range(1, min(m, i) + 1))
    for i in range(n - 1, -1, -1):
        x[i] = x[i] / d[i] - sum(low[k, i] * x[i + k] for k in range(1, min(m, n - 1 - i) + 1))
    return x


def spline_bands(n: int, step: float, smooth: float) -> np.ndarray:
    """Bands of R + smooth Q'Q of the cubic smoothing spline on n equal steps (Reinsch)."""
    bands = np.zeros((3, n - 2))
    bands[0] = 2 / 3 * step + smooth * 6 / step**2
    bands[1] = step / 6 - smooth * 4 / step**2
    bands[2] = smooth / step**2
    return bands


def smoothing_spline(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Values at x (equal steps) of the cubic smoothing spline with the least generalised cross-validation, and its penalty."""
    n, step = len(x), x[1] - x[0]
    second = lambda v: (v[:-2] - 2 * v[1:-1] + v[2:]) / step
    # on equal steps the penalty's eigenvalues stand for those of the hat matrix: the bands are nearly Toeplitz
    angle = np.pi * np.arange(1, n - 1) / (n - 1)
    bend = (2 - 2 * np.cos(angle)) ** 2 / step**2 / (step * (2 / 3 + np.cos(angle) / 3))

    def fit(smooth: float) -> np.ndarray:
        gamma = banded_solve(spline_bands(n, step, smooth), second(y))
        out = y.astype(float).copy()
        for k, f in enumerate((1.0, -2.0, 1.0)):
            out[k : n - 2 + k] -= smooth * f * gamma / step
        return out

    def score(smooth: float) -> float:
        free = 2 + (1 / (1 + smooth * bend)).sum()
        return float(((y - fit(smooth)) ** 2).mean() / (1 - free / n) ** 2) if free < n * (1 - 1e-9) else math.inf

    powers = np.linspace(-12, 6, 37) + 3 * math.log10(step * n)
    best = min(powers, key=lambda p: score(10**p))
    for width in (0.25, 0.1, 0.05):
        best = min(best + width * np.linspace(-1, 1, 5), key=lambda p: score(10**p))
    return fit(10**best), 10**best


def local_fdr(counts: np.ndarray, null_share: float) -> np.ndarray:
    """The local false discovery rate at the grid points: null_share times the null density over the density, not falling with p."""
    if counts.sum() <= 0:
        return np.ones(len(counts))
    at, density = kernel_density(grid(), counts)
    smooth = np.interp(grid(), at, smoothing_spline(at, density)[0])
    rate = np.where(smooth > 0, null_share * normal_density(grid()) / np.maximum(smooth, 1e-300), 1.0)
    held = np.flatnonzero(counts > 0)
    rate[: held[0]], rate[held[-1] + 1 :] = rate[held[0]], rate[held[-1]]  # no p-value lies there
    return np.maximum.accumulate(np.clip(rate, 0, 1))


def null_share(counts: np.ndarray, above: float = 0.8) -> float:
    """Share of p-values of the null, from those above a bound."""
    x = grid()
    return min(1.0, counts[x >= NormalDist().inv_cdf(above)].sum() / max(counts.sum(), 1e-300) / (1 - above))


def look_up(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The table at probits x."""
    return np.interp(x, grid(), table)
