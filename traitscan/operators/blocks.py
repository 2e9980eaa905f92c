"""Block matrices: products and quadratic forms of matrices of any size, and QR of tall matrices.

A matrix is a table of dense tiles (bi, bj, h, w, data, known): tile (bi, bj) starts
at cell (bi * size, bj * size) and has h x w doubles; `known` tells which of its
cells the matrix has, NULL for all. Tiles without cells are not there. A product
meets tiles by their inner block: a task gets at most INNER inner blocks of one
output tile, multiplies them densely, and the partial tiles of an output tile are
added up in groups, so neither a row per cell product nor a whole strip of the
matrix is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscan.operators.assoc import matrix_of
from traitscan.tables import discard, written

#: Rows and columns of a tile; inner blocks and partial tiles that one task holds, at most.
SIZE, INNER = 512, 16
TILE = "bi long, bj long, h int, w int, data binary, known binary"
#: Triangles that one task stacks.
FAN = 64


def _tile(bi: int, bj: int, x: np.ndarray, known: np.ndarray) -> tuple:
    return bi, bj, x.shape[0], x.shape[1], np.ascontiguousarray(x, np.float64).tobytes(), None if known.all() else np.packbits(known).tobytes()


def _table(tiles: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array([t[k] for t in tiles], kind) for k, kind in enumerate(types)], names=["bi", "bj", "h", "w", "data", "known"])


def _dense(h: int, w: int, data: bytes, known: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, np.float64).reshape(h, w)
    return x, np.ones((h, w), bool) if known is None else np.unpackbits(np.frombuffer(known, np.uint8), count=h * w).reshape(h, w).astype(bool)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, w = (max(x.shape[k] for x, _ in parts) for k in (0, 1))
    total, known = np.zeros((h, w)), np.zeros((h, w), bool)
    for x, k in parts:
        total[: x.shape[0], : x.shape[1]] += x
        known[: x.shape[0], : x.shape[1]] |= k
    return total, known


def tiles_of_cells(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of the cells (i, j, v); i and j from 0. NULL cells are not there, repeated cells add up."""

    def pack(t: pa.Table) -> pa.Table:
        i, j, v = (t.column(c).to_numpy() for c in "ijv")
        bi, bj = int(i[0]) // size, int(j[0]) // size
        i, j = i - bi * size, j - bj * size
        x, known = np.zeros((i.max() + 1, j.max() + 1)), np.zeros((i.max() + 1, j.max() + 1), bool)
        np.add.at(x, (i, j), v)
        known[i, j] = True
        return _table([_tile(bi, bj, x, known)])

    rows = cells.where("v is not null").select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double"))
    sums = rows.groupBy("i", "j").agg(F.sum("v").alias("v"))
    return sums.groupBy(F.floor(F.col("i") / size), F.floor(F.col("j") / size)).applyInArrow(pack, TILE)


def cells_of_tiles(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """The cells (i, j, v) of a block matrix."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x, known = _dense(r["h"], r["w"], r["data"], r["known"])
                i, j = np.nonzero(known)
                yield pa.RecordBatch.from_arrays([pa.array(i + r["bi"] * size), pa.array(j + r["bj"] * size), pa.array(x[i, j])], names=["i", "j", "v"])

    return tiles.mapInArrow(unpack, "i long, j long, v double")


def transposed(tiles: DataFrame) -> DataFrame:
    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turned = []
            for r in b.to_pylist():
                x, known = _dense(r["h"], r["w"], r["data"], r["known"])
                turned.append(_tile(r["bj"], r["bi"], x.T, known.T))
            yield from _table(turned).to_batches()

    return tiles.mapInArrow(turn, TILE)


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The tiles of A B. A cell is there if some inner index has it on both sides."""
    names = a.select("bi", F.col("bj").alias("k")).join(b.select(F.col("bi").alias("k"), "bj"), "k")
    names = written(names.withColumn("g", F.floor(F.col("k") / INNER)), "tilenumbers")  # of tiles, not of cells
    renamed = lambda df, row, col: df.select(F.col("bi").alias(row), F.col("bj").alias(col), "h", "w", "data", "known")
    left = renamed(a, "bi", "k").join(names, ["bi", "k"])
    right = renamed(b, "k", "bj").join(names, ["k", "bj"])
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # a and b may be one table

    def multiply(x: pa.Table, y: pa.Table) -> pa.Table:
        others = {r["k"]: r for r in y.to_pylist()}
        parts, key = [], None
        for r in x.to_pylist():
            if r["k"] not in others:
                continue
            other, key = others[r["k"]], (r["bi"], r["bj"])
            (p, pk), (q, qk) = (_dense(t["h"], t["w"], t["data"], t["known"]) for t in (r, other))
            inner = min(p.shape[1], q.shape[0])
            whole = r["known"] is None and other["known"] is None
            known = np.ones((p.shape[0], q.shape[1]), bool) if whole else pk[:, :inner].astype(np.float32) @ qk[:inner].astype(np.float32) > 0
            parts.append((p[:, :inner] @ q[:inner], known))
        return _table([_tile(*key, *_added(parts))] if parts else []).append_column("g", pa.array([x.column("g")[0].as_py()] if parts else [], pa.int64()))

    def add(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        out = _table([_tile(rows[0]["bi"], rows[0]["bj"], *_added([_dense(r["h"], r["w"], r["data"], r["known"]) for r in rows]))])
        return out.append_column("g", pa.array([rows[0]["g"] // INNER], pa.int64()))

    key = ["bi", "bj", "g"]
    out = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(multiply, TILE + ", g long")
    groups = (names.agg(F.max("g")).first()[0] or 0) + 1
    while groups > 1:
        out = out.groupBy("bi", "bj", F.floor(F.col("g") / INNER)).applyInArrow(add, TILE + ", g long")
        groups = -(-groups // INNER)
    return out.drop("g")


def quadratic_form(x: DataFrame, a: DataFrame) -> DataFrame:
    """The tiles of X' A X."""
    return product(transposed(x), written(product(a, x), "tiles"))


# ---------------------------------------------------------------- tall matrices


def triangle(x: np.ndarray) -> np.ndarray:
    """R of x = Q R with a diagonal that is not negative, square."""
    n = x.shape[1]
    r = np.zeros((n, n))
    if len(x):
        found = np.linalg.qr(x, mode="r")
        r[: len(found)] = found * np.where(np.diagonal(found) < 0, -1.0, 1.0)[:, None]
    return r


def tall_r(df: DataFrame, n: int, value: str = "values") -> np.ndarray:
    """R of the QR factorisation of all rows of n values, by a tree of stacked triangles.

    Every task reduces its rows to one triangle; FAN triangles at a time are
    stacked and reduced, level by level, until one is left. Rows of another width,
    or with a missing value, take no part.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, n))
        for b in batches:
            if b.num_rows:
                r = triangle(np.vstack([r, matrix_of(b.column(0))]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def stack(t: pa.Table) -> pa.Table:
        r = triangle(np.vstack([np.frombuffer(x, np.float64).reshape(n, n) for x in t.column("r").to_pylist()]))
        return pa.table({"g": pa.array([t.column("g")[0].as_py() // FAN]), "r": pa.array([r.tobytes()], pa.binary())})

    v = F.col(value).cast("array<double>")
    rows = df.select(v.alias("v")).where(F.size("v") == n).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    level = written(rows.mapInArrow(local, "r binary").select(F.spark_partition_id().cast("long").alias("g"), "r"), "triangles")
    while level.limit(2).count() > 1:
        below, level = level, written(level.groupBy(F.floor(F.col("g") / FAN)).applyInArrow(stack, "g long, r binary"), "triangles")
        discard(below)
    last = level.first()
    discard(level)
    return np.zeros((n, n)) if last is None else np.frombuffer(last.r, np.float64).reshape(n, n)
