import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from traitscan import queries
from traitscan.functions import arrays as A
from traitscan.functions import stats
from traitscan.operators import assoc, matrix, sva


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, values array<double>")


def ols(x, y, c):
    """Beta, t, and residual degrees of freedom of x in y ~ c + x."""
    d = np.column_stack([c, x])
    b, *_ = np.linalg.lstsq(d, y, rcond=None)
    df = len(y) - np.linalg.matrix_rank(d)
    s2 = ((y - d @ b) ** 2).sum() / df
    return b[-1], b[-1] / math.sqrt(s2 * np.linalg.pinv(d.T @ d)[-1, -1]), df


def scan_pairs_native(x, y, rsq0, n):
    """The same pairs by higher-order functions only, a cross join of small inputs."""
    joined = x.selectExpr("id AS x_id", "z AS zx", "sd AS x_sd").join(y.selectExpr("id AS y_id", "z AS zy", "sd AS y_sd"))
    r = A.dot("zx", "zy") / (n - 1)
    return joined.select("x_id", "y_id", r.alias("r"), "x_sd", "y_sd").where(F.col("r") * F.col("r") >= rsq0)


def test_blocks_without_a_threshold_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(assoc, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(assoc, "BLOCK_PAIRS", 20)
    rng = np.random.default_rng(8)
    x, y = (assoc.prepare(frame(spark, rng.normal(size=(k, 12))), np.ones((12, 1)) / 12**0.5) for k in (17, 9))
    pairs = assoc.scan_pairs(x, y, 0.0, 12)
    assert pairs.count() == 17 * 9 and pairs.distinct().count() == 17 * 9


@pytest.mark.parametrize("force_blocks", [False, True])
def test_matches_least_squares(spark, monkeypatch, force_blocks):
    if force_blocks:
        monkeypatch.setattr(assoc, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(assoc, "BLOCK_BYTES", 8 * 30 * 2)
    rng = np.random.default_rng(1)
    n = 30
    x, y = rng.normal(size=(5, n)), rng.normal(size=(4, n))
    y[0] += 2 * x[1]
    design = assoc.design_matrix(n, {"age": rng.normal(size=n).tolist()}, {"batch": [i % 3 for i in range(n)]}, [("age", "batch")])
    got = {(r.x_id, r.y_id): r for r in assoc.association(frame(spark, x), frame(spark, y), n, design).collect()}
    assert len(got) == 20
    for (i, j), r in got.items():
        b, t, df = ols(x[i], y[j], design)
        assert r.fx == pytest.approx(b, rel=1e-8)
        assert r.t == pytest.approx(t, rel=1e-8)
        assert r.rsq == pytest.approx(t * t / (t * t + df), rel=1e-8)


def test_rank_deficient_design():
    d = assoc.design_matrix(6, {"a": [1, 2, 3, 4, 5, 6], "b": [2, 4, 6, 8, 10, 12]})
    q = assoc.orthonormal(d)
    assert q.shape == (6, 2)
    assert np.allclose(q.T @ q, np.eye(2))


def test_rows_that_cannot_be_scanned_go(spark):
    x = spark.createDataFrame([(1, [1.0, 2.0, 4.0]), (2, [1.0, 1.0, 1.0]), (3, [1.0, None, 2.0]), (4, None), (5, [1.0, float("nan"), 2.0])], "id long, values array<double>")
    assert [r.id for r in assoc.prepare(x, assoc.orthonormal(np.ones((3, 1)))).collect()] == [1]
    assert assoc.association(x.where("id > 9"), x, 3).count() == 0


def test_threshold_pval_is_exact(spark):
    rng = np.random.default_rng(2)
    x, y = frame(spark, rng.normal(size=(20, 12))), frame(spark, rng.normal(size=(20, 12)))
    every = assoc.association(x, y, 12)
    some = assoc.association(x, y, 12, threshold=("pval", 0.05))
    assert every.where(F.col("log10p") <= math.log10(0.05)).count() == some.count() > 0


def test_native_scan_agrees(spark):
    rng = np.random.default_rng(3)
    q = assoc.orthonormal(np.ones((10, 1)))
    x, y = (assoc.prepare(frame(spark, rng.normal(size=(6, 10))), q) for _ in range(2))
    key = lambda df: sorted((r.x_id, r.y_id, round(r.r, 9)) for r in df.collect())
    assert key(assoc.scan_pairs(x, y, 0.1, 10)) == key(scan_pairs_native(x, y, 0.1, 10))


def test_perfect_pair(spark):
    x = frame(spark, [[1, 2, 3, 4]])
    r = assoc.association(x, x, 4).first()
    assert r.rsq == pytest.approx(1) and (math.isinf(r.t) or r.t > 1e6)


def test_t_tail_known_values():
    # Student t: two-sided p of 2.0 with 10 df is 0.07338803; of 1 with 1 df is 0.5
    p = lambda t, v: math.exp(stats.ln_inc_beta(np.array([v / (v + t * t)]), np.array([v / 2]), np.array([0.5]))[0])
    assert p(2.0, 10) == pytest.approx(0.07338803, rel=1e-6)
    assert p(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    assert stats.t_quantile(0.025, 10) == pytest.approx(2.228139, rel=1e-6)
    assert stats.rsq_of_p(0.05, 10) == pytest.approx(2.228139**2 / (10 + 2.228139**2), rel=1e-6)
    deep = stats.ln_inc_beta(np.array([1e-30]), np.array([30.0]), np.array([0.5]))[0]
    assert -2100 < deep < -2000


def test_matrix_products(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(7, 3))
    df = frame(spark, a)
    assert np.allclose(matrix.gram_matrix(df, 3), a.T @ a)
    cells = matrix.to_long(df)
    prod = matrix.multiply(matrix.transpose(cells), cells).collect()
    assert {(r.i, r.j): round(r.v, 9) for r in prod} == {(i, j): round((a.T @ a)[i, j], 9) for i in range(3) for j in range(3)}
    s, v = matrix.svd_rows(df, 3, 2)
    assert np.allclose(s, np.linalg.svd(a)[1][:2])
    wide = {r.id: r["values"] for r in matrix.to_wide(cells).collect()}
    assert np.allclose([wide[i] for i in range(7)], a)


def test_surrogate_found(spark):
    rng = np.random.default_rng(5)
    n = 20
    hidden, group = rng.normal(size=n), np.repeat([0.0, 1.0], n // 2)
    x = rng.normal(size=(200, n)) * 0.3
    x[:120] += np.outer(rng.normal(size=120), hidden)
    x[150:] += np.outer(rng.normal(size=50), group)
    alt = np.column_stack([np.ones(n), group])
    count, _ = sva.number_of_surrogates(frame(spark, x), alt, rounds=5)
    sv = sva.surrogate_variables(frame(spark, x), alt, count=1, rounds=2)
    assert count >= 1
    assert abs(np.corrcoef(sv[:, 0], hidden)[0, 1]) > 0.9


def test_surrogate_query_finds_the_count(spark, monkeypatch):
    seen = []
    whole, count = sva.surrogate_variables, sva.number_of_surrogates
    monkeypatch.setattr(sva, "surrogate_variables", lambda *a, **b: seen.append(b) or whole(*a, **b))
    monkeypatch.setattr(sva, "number_of_surrogates", lambda *a, **b: seen.append(count(*a, **b)[0]) or (seen[-1], None))
    got = queries.QUERIES["surrogate_variables"](spark, DATA).collect()
    assert seen[0]["rounds"] == 5 and len(got) == queries.DIM * seen[1]
