"""Block products, quadratic forms and tall QR against numpy."""

import numpy as np
import pytest

from traitscan.operators import blocks, matrix


def cells(spark, x, keep=None):
    return spark.createDataFrame([(i, j, float(x[i, j])) for i in range(len(x)) for j in range(x.shape[1]) if keep is None or keep[i, j]], "i long, j long, v double")


def found(df):
    return {(r.i, r.j): r.v for r in df.collect()}


@pytest.mark.parametrize("inner", [16, 2])
def test_products(spark, monkeypatch, inner):
    monkeypatch.setattr(blocks, "INNER", inner)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(23, 41)), rng.normal(size=(41, 17))
    got = found(matrix.multiply(cells(spark, a), cells(spark, b), 7))
    assert len(got) == 23 * 17 and all(np.isclose(v, (a @ b)[k]) for k, v in got.items())
    ka, kb = rng.random(a.shape) < 0.1, rng.random(b.shape) < 0.1
    got = found(matrix.multiply(cells(spark, a, ka), cells(spark, b, kb), 7))
    want = {k for k in np.ndindex(23, 17) if (ka[k[0]] & kb[:, k[1]]).any()}
    assert set(got) == want and all(np.isclose(got[k], ((a * ka) @ (b * kb))[k]) for k in want)
    assert matrix.multiply(cells(spark, a).limit(0), cells(spark, b), 7).count() == 0


def test_quadratic_form_and_odd_cells(spark):
    rng = np.random.default_rng(2)
    x, a = rng.normal(size=(30, 9)), rng.normal(size=(30, 30))
    tiles = lambda m: blocks.tiles_of_cells(cells(spark, m), 8)
    got = found(blocks.cells_of_tiles(blocks.quadratic_form(tiles(x), tiles(a)), 8))
    assert len(got) == 81 and all(np.isclose(v, (x.T @ a @ x)[k]) for k, v in got.items())
    odd = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (5, 1, None), (10**9, 3, 4.0)], "i long, j long, v double")
    assert found(blocks.cells_of_tiles(blocks.tiles_of_cells(odd, 8), 8)) == {(0, 0): 3.0, (10**9, 3): 4.0}


def test_a_product_makes_no_row_per_cell_product(spark):
    """1,000 x 1,000: 16 tile products, 1,000,000,000 cell products."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1000, 1000))
    made = [(bi, bj, 256 if bi < 3 else 232, 256 if bj < 3 else 232, np.ascontiguousarray(x[256 * bi : 256 * bi + 256, 256 * bj : 256 * bj + 256]).tobytes(), None) for bi in range(4) for bj in range(4)]
    tiles = spark.createDataFrame([(*t[:4], bytearray(t[4]), t[5]) for t in made], blocks.TILE)
    got = blocks.product(tiles, tiles).collect()
    assert len(got) == 16
    for r in got:
        assert np.allclose(np.frombuffer(r.data, np.float64).reshape(r.h, r.w), (x @ x)[256 * r.bi : 256 * r.bi + 256, 256 * r.bj : 256 * r.bj + 256])


def test_tall_qr_keeps_small_singular_values(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 3)
    rng = np.random.default_rng(3)
    u, v = np.linalg.qr(rng.normal(size=(400, 6)))[0], np.linalg.qr(rng.normal(size=(6, 6)))[0]
    s = np.array([1, 1e-2, 1e-4, 1e-6, 1e-8, 1e-10])
    x = u * s @ v.T
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(900, [1.0]), (901, None), (902, [None] * 6)]
    df = spark.createDataFrame(rows, "id long, values array<double>").repartition(11)
    values, vectors = matrix.svd_rows(df, 6, 6)
    assert np.allclose(values / s, 1, atol=1e-5)  # the Gram matrix ends near 1e-8
    assert np.allclose(np.abs(vectors.T @ v), np.eye(6), atol=1e-4)
    r = blocks.tall_r(df, 6)
    assert (np.diagonal(r) >= 0).all() and np.allclose(r.T @ r, x.T @ x)
    q = matrix.orthonormal_rows(df.where("id < 900"), 6)
    assert np.allclose(matrix.gram_matrix(q, 6), np.eye(6), atol=1e-8)
    assert (blocks.tall_r(df.limit(0), 6) == 0).all()
