"""All-pairs association: residualise, standardise, scan by matrix products, derive statistics.

Covariates are regressed out of both sides once (Frisch-Waugh-Lovell), after
which each pair is one dot product. The R² bound is applied inside the scan, so
only survivors ever become rows; p-values are computed for those alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscan.functions import arrays as A
from traitscan.functions.stats import log10_t_p, rsq_of_p

#: Bytes of responses that are broadcast to every task; above it both sides are dealt to blocks.
BROADCAST_BYTES = 64 << 20
BLOCK_BYTES = 16 << 20
#: Pairs that one pair of blocks returns, at most, where no threshold keeps any back.
BLOCK_PAIRS = 4_000_000


def design_matrix(n: int, numeric: dict[str, list[float]] | None = None, factors: dict[str, list] | None = None, interactions: list[tuple[str, str]] = ()) -> np.ndarray:
    """Intercept, numeric terms, factor dummies (first level dropped) and full cross products."""
    terms: dict[str, np.ndarray] = {k: np.asarray(v, float)[:, None] for k, v in (numeric or {}).items()}
    for k, v in (factors or {}).items():
        levels = sorted(set(v))
        terms[k] = np.array([[float(x == lv) for lv in levels[1:]] for x in v]).reshape(n, -1)
    for a, b in interactions:
        if a not in terms or b not in terms:
            raise ValueError(f"unknown covariate in {a}*{b}")
        terms[f"{a}*{b}"] = np.einsum("ni,nj->nij", terms[a], terms[b]).reshape(n, -1)
    out = np.hstack([np.ones((n, 1)), *terms.values()])
    if np.isnan(out).any():
        raise ValueError("covariates must not be missing")
    return out


def orthonormal(design: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """An orthonormal basis of the design's columns; deficient columns are left out."""
    basis: list[np.ndarray] = []
    for column in design.T:
        left = column.astype(float)
        for _ in range(2):
            for q in basis:
                left = left - q * (q @ left)
        size = np.linalg.norm(left)
        if size > tolerance:
            basis.append(left / size)
    return np.array(basis).T.reshape(len(design), -1)


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def complete_rows(df: DataFrame, value: str = "values") -> DataFrame:
    """Rows whose vector is there and holds no missing or non-finite element."""
    return df.where(F.col(value).isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def prepare(df: DataFrame, basis: np.ndarray, id_col: str = "id", value: str = "values") -> DataFrame:
    """(id, z, sd): residuals off the basis, standardised; rows without variance go."""
    n = len(basis)
    id_type = df.schema[id_col].dataType.simpleString()
    rows = complete_rows(df.select(F.col(id_col).alias("id"), F.col(value).cast("array<double>").alias("values")))
    rows = rows.where(F.size("values") == n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix_of(b.column(1))
            if not len(x):
                continue
            res = x - (x @ basis) @ basis.T
            res -= res.mean(axis=1, keepdims=True)
            sd = np.sqrt((res * res).sum(axis=1) / (n - 1))
            ok = sd > 1e-12 * np.maximum(1.0, np.abs(x).max(axis=1))
            z = res[ok] / sd[ok, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, n), pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), lists, pa.array(sd[ok])], names=["id", "z", "sd"])

    return rows.mapInArrow(run, f"id {id_type}, z array<double>, sd double")


def _hits(zx: np.ndarray, zy: np.ndarray, rsq0: float):  # noqa: ANN202
    """(rows, columns, r) of the pairs with r² >= rsq0."""
    n = zx.shape[1]
    step = max(1, (8 << 20) // (8 * max(1, len(zy))))
    for at in range(0, len(zx), step):
        r = zx[at : at + step] @ zy.T / (n - 1)
        i, j = np.nonzero(r * r >= rsq0)
        yield i + at, j, r[i, j]


def scan_pairs(x: DataFrame, y: DataFrame, rsq0: float, n: int) -> DataFrame:
    """(x_id, y_id, r, x_sd, y_sd) of all pairs of prepared rows with r² >= rsq0.

    A response side below BROADCAST_BYTES (checked by a count) goes to every task;
    otherwise both sides are dealt to blocks and each pair of blocks is one
    matrix product.
    """
    spark = x.sparkSession
    xt, yt = x.schema["id"].dataType, y.schema["id"].dataType
    schema = f"x_id {xt.simpleString()}, y_id {yt.simpleString()}, r double, x_sd double, y_sd double"
    names = ["x_id", "y_id", "r", "x_sd", "y_sd"]
    rows = y.count()
    if rows * n * 8 <= BROADCAST_BYTES:
        got = y.toArrow().combine_chunks()
        ids, sds = got.column("id").combine_chunks(), got.column("sd").to_numpy()
        z = matrix_of(got.column("z").combine_chunks())
        sent = spark.sparkContext.broadcast((ids, z, sds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y_ids, zy, y_sd = sent.value
            for b in batches:
                zx, x_sd = matrix_of(b.column(1)), b.column(2).to_numpy()
                if not len(zx) or not len(zy):
                    continue
                for i, j, r in _hits(zx, zy, rsq0):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), y_ids.take(pa.array(j)), pa.array(r), pa.array(x_sd[i]), pa.array(y_sd[j])], names=names)

        return x.mapInArrow(run, schema)

    per_block = max(1, BLOCK_BYTES // (8 * n))
    if rsq0 <= 0:
        per_block = min(per_block, math.isqrt(BLOCK_PAIRS))
    bx, by = max(1, -(-x.count() // per_block)), max(1, -(-rows // per_block))
    deal = lambda df, own, other, k, m: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(k))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>")))
    left, right = deal(x, "bx", "by", bx, by), deal(y, "by", "bx", by, bx)

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks()
        parts = []
        if a.num_rows and b.num_rows:
            zx, zy = (matrix_of(t.column("z").combine_chunks()) for t in (a, b))
            for i, j, r in _hits(zx, zy, rsq0):
                parts.append(pa.table([a.column("id").take(pa.array(i)), b.column("id").take(pa.array(j)), pa.array(r), a.column("sd").take(pa.array(i)), b.column("sd").take(pa.array(j))], names=names))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], a.column("id").type), pa.array([], b.column("id").type), *[pa.array([], pa.float64())] * 3], names=names)

    return left.groupBy("bx", "by").cogroup(right.groupBy("bx", "by")).applyInArrow(product, schema)


def with_statistics(pairs: DataFrame, dfe: int, df_offset: int = 0, p_value: bool = True) -> DataFrame:
    """rsq, fx, t and log10p; R² and t use dfe, p uses dfe - df_offset."""
    r = F.col("r")
    rsq = r * r
    t = F.signum(r) * F.sqrt(F.try_divide(rsq * dfe, F.greatest(1 - rsq, F.lit(0.0))))
    t = F.when(1 - rsq <= 0, F.signum(r) * F.lit(float("inf"))).otherwise(t)
    out = pairs.select("x_id", "y_id", rsq.alias("rsq"), (r * F.col("y_sd") / F.col("x_sd")).alias("fx"), t.alias("t"))
    return out.withColumn("log10p", log10_t_p("t", F.lit(float(dfe - df_offset)))) if p_value else out


def association(x: DataFrame, y: DataFrame, n: int, design: np.ndarray | None = None, threshold: tuple[str, float] | None = None, df_offset: int = 0, id_col: str = "id", value: str = "values") -> DataFrame:
    """All pairs above the threshold: None, ("rsq", r0) or ("pval", p0).

    x and y hold (id, array of n doubles); samples are matched by place.
    """
    basis = orthonormal(design if design is not None else np.ones((n, 1)))
    dfe = n - basis.shape[1] - 1
    if dfe - df_offset <= 0:
        raise ValueError("no degrees of freedom are left")
    kind, bound = threshold or ("none", 0.0)
    rsq0 = rsq_of_p(bound, dfe, df_offset) if kind == "pval" else bound if kind == "rsq" else 0.0
    pairs = scan_pairs(prepare(x, basis, id_col, value), prepare(y, basis, id_col, value), rsq0, n)
    return with_statistics(pairs, dfe, df_offset)


def pair_layout(pairs: DataFrame, layout: str = "full", simplify: bool = False) -> DataFrame:
    """The three output layouts: full, rsq_only (with the direction as a sign), pval_only."""
    cut = (lambda c: A.half_up(F.col(c), 4)) if simplify else F.col
    if layout == "rsq_only":
        return pairs.select("x_id", "y_id", cut("rsq").alias("rsq"), F.when(F.col("fx") < 0, "-").otherwise("+").alias("dir"))
    if layout == "pval_only":
        return pairs.select(cut("log10p").alias("log10p"))
    return pairs.select("x_id", "y_id", *(cut(c).alias(c) for c in ("rsq", "fx", "t", "log10p")))


def top_k_per_feature(pairs: DataFrame, k: int, by: str = "x_id") -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(F.desc("rsq"), "y_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
