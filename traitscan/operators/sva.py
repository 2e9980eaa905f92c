"""Surrogate variables of a tall matrix (features x samples), after Leek and Storey.

All work over features is one pass per step: partial Gram matrices, partial
counts of F statistics' probits, and permuted residuals. Only samples x samples
matrices and bounded histograms reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscan.functions import density
from traitscan.functions.stats import ln_inc_beta
from traitscan.operators.assoc import complete_rows, matrix_of, orthonormal
from traitscan.operators.matrix import gram_matrix, times

def _residual_map(basis: np.ndarray) -> np.ndarray:
    return np.eye(len(basis)) - basis @ basis.T


def _permuted(df: DataFrame, seed: int) -> DataFrame:
    """Every row's values in a random order of its own, fixed by the seed and the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix_of(b.column(1))
            for r, key in enumerate(b.column(0).to_pylist()):
                x = x if x.flags.writeable else x.copy()
                x[r] = np.random.Generator(np.random.PCG64([seed, key & 0xFFFFFFFF])).permutation(x[r])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1] if x.size else 1)), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["_h", "values"])

    return df.select(F.xxhash64("id").alias("_h"), "values").mapInArrow(run, "_h long, values array<double>")


def number_of_surrogates(df: DataFrame, design: np.ndarray, rounds: int = 20, level: float = 0.1, seed: int = 1) -> tuple[int, np.ndarray]:
    """(count, p-values): how many residual components explain more than in permuted rows."""
    n = len(design)
    rest = _residual_map(orthonormal(design))
    rank = n - orthonormal(design).shape[1]
    res = times(complete_rows(df).select("id", "values"), rest)
    share = lambda g: (lambda v: v / max(v.sum(), 1e-300))(np.sort(np.maximum(np.linalg.eigvalsh(g), 0))[::-1][:rank])
    seen = share(gram_matrix(res, n))
    above = np.zeros(rank)
    for k in range(rounds):
        above += share(gram_matrix(times(_permuted(res, seed + k), rest), n)) >= seen
    p = np.maximum.accumulate(above / rounds)
    return int((p <= level).sum()), p


def f_tests(df: DataFrame, models: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(id, values, one probit of p per name) of the nested linear models (alternative, null) of every row, in one pass."""
    bases = [(orthonormal(alt), orthonormal(null)) for alt, null in models.values()]
    id_type = df.schema["id"].dataType.simpleString()

    def p_of(x: np.ndarray, qa: np.ndarray, q0: np.ndarray) -> np.ndarray:
        d1, d2 = qa.shape[1] - q0.shape[1], len(qa) - qa.shape[1]
        full = ((x - (x @ qa) @ qa.T) ** 2).sum(axis=1)
        small = ((x - (x @ q0) @ q0.T) ** 2).sum(axis=1)
        f = np.maximum((small - full) / d1, 0) / np.maximum(full / d2, 1e-300)
        return density.normal_quantile(np.exp(ln_inc_beta(d2 / (d2 + d1 * f), np.full(len(f), d2 / 2), np.full(len(f), d1 / 2))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix_of(b.column(1))
            if len(x):
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p_of(x, *q)) for q in bases)], names=["id", "values", *models])

    return complete_rows(df).select("id", "values").mapInArrow(run, f"id {id_type}, values array<double>, " + ", ".join(f"`{m}` double" for m in models))


def local_fdrs(tests: DataFrame, names: list[str]) -> list[np.ndarray]:
    """For each column of probits the table of its local false discovery rates."""
    return [density.local_fdr(c, density.null_share(c)) for c in density.probit_counts(tests, names)]


def _weighted(tests: DataFrame, alt: np.ndarray, sv: np.ndarray) -> DataFrame:
    """Rows times their chance to be moved by surrogates and not by the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix_of(b.column(1))
            if len(x):
                w = (1 - density.look_up(sv, b.column(3).to_numpy())) * density.look_up(alt, b.column(2).to_numpy())
                x = x * w[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "values"])

    return tests.mapInArrow(run, f"id {tests.schema['id'].dataType.simpleString()}, values array<double>")


def surrogate_variables(df: DataFrame, alt: np.ndarray, null: np.ndarray | None = None, count: int | None = None, rounds: int = 5, seed: int = 1) -> np.ndarray:
    """samples x count surrogate variables: iterated weights, weighted Gram, top vectors."""
    n = len(alt)
    null = np.ones((n, 1)) if null is None else null
    if count is None:
        count = number_of_surrogates(df, alt, seed=seed)[0]
    if count == 0:
        return np.zeros((n, 0))
    rows = complete_rows(df).select("id", F.col("values").cast("array<double>").alias("values"))
    _, vectors = np.linalg.eigh(gram_matrix(times(rows, _residual_map(orthonormal(alt))), n))
    sv = vectors[:, ::-1][:, :count]
    for _ in range(rounds):
        tests = f_tests(rows, {"p_alt": (np.hstack([alt, sv]), np.hstack([null, sv])), "p_sv": (np.hstack([null, sv]), null)})
        weighted = _weighted(tests, *local_fdrs(tests, ["p_alt", "p_sv"]))
        _, vectors = np.linalg.eigh(gram_matrix(times(weighted, np.eye(n) - 1.0 / n), n))
        sv = vectors[:, ::-1][:, :count]
    return sv * np.where(np.take_along_axis(sv, np.abs(sv).argmax(axis=0)[None], 0) < 0, -1, 1)
