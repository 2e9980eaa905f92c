"""Matrices as rows (id, array of doubles) or long cells (i, j, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscan.functions import arrays as A
from traitscan.operators import blocks
from traitscan.operators.assoc import matrix_of


def to_long(df: DataFrame, id_col: str = "id", value: str = "values") -> DataFrame:
    return df.select(F.col(id_col).alias("i"), F.posexplode(value).alias("j", "v"))


def to_wide(cells: DataFrame) -> DataFrame:
    """Rows from cells; a row's cells are ordered by j."""
    return cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("_c")).select(F.col("i").alias("id"), F.col("_c.v").alias("values"))


def standardize_rows(df: DataFrame, value: str = "values") -> DataFrame:
    """Rows centred and scaled by their sample deviation; NULL where it is 0. Native."""
    v = F.col(value)
    out = df.withColumn("_m", A.mean(v)).withColumn("sd", A.sd(v))
    return out.withColumn(value, F.when(F.col("sd") > 0, F.transform(v, lambda x: (x - F.col("_m")) / F.col("sd")))).drop("_m")


def standardized_cells(df: DataFrame, id_col: str = "id", value: str = "values") -> DataFrame:
    """The cells (i, j, v) of standardize_rows: mean and deviation are found once a row, then each cell is scaled."""
    rows = df.select(F.col(id_col).alias("i"), A.mean(F.col(value)).alias("_m"), A.sd(F.col(value)).alias("_s"), F.col(value).alias("_x"))
    return rows.select("i", "_m", "_s", F.posexplode("_x").alias("j", "v")).select("i", "j", F.when(F.col("_s") > 0, (F.col("v") - F.col("_m")) / F.col("_s")).alias("v"))


def column_statistics(df: DataFrame, value: str = "values") -> DataFrame:
    """Per column: sum, mean and sum of squares, pre-aggregated."""
    return df.select(F.posexplode(value).alias("j", "v")).groupBy("j").agg(F.sum("v").alias("col_sum"), F.avg("v").alias("col_mean"), F.sum(F.col("v") * F.col("v")).alias("col_ss"))


def gram(df: DataFrame, n: int, value: str = "values") -> DataFrame:
    """Cells (i, j, v) of X'X for rows of n values: one small matrix per task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for b in batches:
            x = matrix_of(b.column(0))
            if len(x):
                total += x.T @ x
        i, j = np.divmod(np.arange(n * n), n)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "v"])

    rows = df.where(F.size(value) == n).select(F.col(value).cast("array<double>"))
    return rows.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def gram_matrix(df: DataFrame, n: int, value: str = "values") -> np.ndarray:
    """X'X on the driver; n x n numbers, however many rows."""
    out = np.zeros((n, n))
    for r in gram(df, n, value).collect():
        out[r.i, r.j] = r.v
    return out


def times(df: DataFrame, right: np.ndarray, value: str = "values") -> DataFrame:
    """Every row times a small matrix (n x m)."""
    m = right.shape[1]
    names = df.columns
    at = names.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = matrix_of(b.column(at)) @ right if b.num_rows else np.zeros((0, m))
            col = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, m), pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], col, *b.columns[at + 1 :]], names=names)

    schema = ", ".join(f"`{f.name}` " + ("array<double>" if f.name == value else f.dataType.simpleString()) for f in df.schema.fields)
    return df.withColumn(value, F.col(value).cast("array<double>")).mapInArrow(run, schema)


def multiply(a: DataFrame, b: DataFrame, size: int = blocks.SIZE) -> DataFrame:
    """Product of two matrices in cells, tile by tile; i and j count from 0."""
    return blocks.cells_of_tiles(blocks.product(blocks.tiles_of_cells(a, size), blocks.tiles_of_cells(b, size)), size)


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(a: DataFrame, b: DataFrame, scale: float = 1.0) -> DataFrame:
    """a + scale * b, cell by cell."""
    return a.unionByName(b.withColumn("v", F.col("v") * scale)).groupBy("i", "j").agg(F.sum("v").alias("v"))


def sse(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of squared differences of two matrices in cells."""
    return add(a, b, -1.0).agg(F.sum(F.col("v") * F.col("v")).alias("sse"))


def bind_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (id, values) of both matrices side by side, matched by id; ids of one side alone go."""
    right = b.select("id", F.col("values").alias("_right"))
    return a.join(right, "id").select("id", F.concat("values", "_right").alias("values"))


def bind_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (id, values) of both matrices one below the other; other widths than a's first row are an error."""
    first = a.select(F.size("values").alias("n")).first()
    rows = a.select("id", "values").unionByName(b.select("id", "values"))
    bad = F.raise_error(F.format_string("row of %d values, not %d", F.size("values"), F.lit(first.n if first else -1))).cast("array<double>")
    return rows.withColumn("values", F.when(F.lit(first is None) | (F.size("values") == F.lit(first.n if first else -1)), F.col("values")).otherwise(bad))


def complete_samples(cells: DataFrame) -> DataFrame:
    """Cells of the columns that have no missing value in any row (listwise deletion)."""
    bad = cells.where(F.col("v").isNull() | F.isnan("v")).select("j").distinct()
    return cells.join(bad, "j", "left_anti")


def svd_rows(df: DataFrame, n: int, k: int, value: str = "values") -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values and right vectors of a tall matrix, from the triangle of its QR factorisation.

    The Gram matrix would square the condition number; the triangle keeps it.
    """
    _, values, vectors = np.linalg.svd(blocks.tall_r(df, n, value))
    return values[:k], vectors[:k].T


def orthonormal_rows(df: DataFrame, n: int, value: str = "values") -> DataFrame:
    """Q of the QR factorisation: rows with orthonormal columns. A second pass mends what an ill-conditioned triangle loses."""
    out = df
    for _ in range(2):
        out = times(out, np.linalg.inv(blocks.tall_r(out, n, value)), value)
    return out
