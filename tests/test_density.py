"""Local false discovery rates against dense versions."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from traitscan.functions import density


def test_quantiles(spark):
    p = [0.5, 0.975, 0.025, 1e-5, 0.0, 1.0]
    got = density.normal_quantile(np.array([*p, np.nan]))
    assert got[:4] == pytest.approx([NormalDist().inv_cdf(x) for x in p[:4]]) and got[4] == pytest.approx(-density.EDGE) and math.isnan(got[6])
    rows = spark.createDataFrame([(x,) for x in [*p, None]], "p double").select(density.probit("p").alias("x")).collect()
    assert [r.x for r in rows[:6]] == pytest.approx(got[:6].tolist()) and rows[6].x is None


def test_banded_solve():
    rng = np.random.default_rng(1)
    for m in (0, 1, 2):
        for n in (1, 2, 3, 9):
            bands = np.vstack([np.full(n, 5.0), *(rng.normal(size=n) for _ in range(m))])
            a = np.diag(bands[0]) + sum((np.diag(bands[k, : n - k], k) + np.diag(bands[k, : n - k], -k) for k in range(1, m + 1) if k < n), np.zeros((n, n)))
            y = rng.normal(size=n)
            assert np.allclose(a @ density.banded_solve(bands, y), y)


def test_spline_is_the_dense_one():
    n = 60
    x = np.linspace(0, 3, n)
    y = np.sin(2 * x) + np.random.default_rng(2).normal(size=n) * 0.1
    fit, smooth = density.smoothing_spline(x, y)
    h = x[1] - x[0]
    q = np.zeros((n, n - 2))
    for k in range(n - 2):
        q[k : k + 3, k] = np.array([1, -2, 1]) / h
    r = np.diag(np.full(n - 2, 2 / 3 * h)) + np.diag(np.full(n - 3, h / 6), 1) + np.diag(np.full(n - 3, h / 6), -1)
    penalty = q @ np.linalg.solve(r, q.T)
    assert np.allclose(fit, np.linalg.solve(np.eye(n) + smooth * penalty, y))

    def gcv(s):
        hat = np.linalg.inv(np.eye(n) + s * penalty)
        return ((y - hat @ y) ** 2).mean() / (1 - np.trace(hat) / n) ** 2

    least = min(gcv(10**p) for p in np.linspace(-8, 3, 200))
    assert gcv(smooth) <= 1.02 * least and np.abs(fit - np.sin(2 * x)).mean() < 0.06


def test_density_and_rates_from_counts(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.random(3000), 10 ** -rng.uniform(2, 7, 1000)])
    x = density.normal_quantile(p)
    rows = spark.createDataFrame([(float(v), None) for v in x], "a double, b double").repartition(5)
    counts = density.probit_counts(rows, ["a", "b"])
    assert counts[0].sum() == pytest.approx(4000) and counts[1].sum() == 0
    assert (counts[0] * density.grid()).sum() == pytest.approx(x.sum(), abs=1e-6)
    at, got = density.kernel_density(density.grid(), counts[0])
    h = density.ADJUST * density.bandwidth(np.sort(x), np.ones(len(x)))
    dense = density.normal_density((at[:, None] - x) / h).sum(axis=1) / (h * len(x))
    assert np.abs(got - dense).max() < 2e-3 * dense.max()
    share = density.null_share(counts[0])
    assert share == pytest.approx(0.75, abs=0.06)
    table = density.local_fdr(counts[0], share)
    assert (np.diff(table) >= 0).all() and table.min() >= 0 and table.max() <= 1
    rate = density.look_up(table, density.normal_quantile(np.array([1e-6, 1e-3, 0.5])))
    assert rate[0] < 0.02 < rate[1] < 0.5 < rate[2]
    assert (density.local_fdr(counts[1], 1.0) == 1).all()
