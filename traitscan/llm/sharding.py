"""Operator 2: histogram sort into shards of near-equal bytes.

Rows are ordered by one 64-bit key: the high 40 bits hash the text, the low 24
bits hash the id, so equal texts lie together and a group of copies that is
larger than a shard can still be cut inside. Each round counts the exact bytes
below candidate boundaries in every partition (one small row per task and bin
reaches the driver) and narrows the interval around each splitter until its
bytes are within the tolerance. Boundaries between groups are tried first.
When the splitters stand, rows are exchanged once. Rows that repeat an id and a
text have one key; where such a group is larger than a boundary may miss, the
boundary goes through it by the number of its rows, which have one size, and the
rows of a group that is larger than a bin are numbered by many tasks.

Cases: a null text has no bytes; a null id hashes as its own value; ties (equal
keys) are numbered by id; rows that repeat an id and a text may be parted; an empty
table gives no rows; other columns travel along, those named size, shard or slot
are replaced by the result's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitscan.llm.common import shared_table

GROUP_BITS = 24


def shard_key(id_col: str, text_col: str) -> F.Column:
    text = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 64 - 39)
    low = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 64 - GROUP_BITS)
    return F.shiftleft(text, GROUP_BITS).bitwiseOR(low)  # 0 <= key < 2**63


def histogram(keys: DataFrame, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact (bytes, rows) of each bin that the sorted bounds part; len(bounds) + 1 bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(bounds) + 1
        held, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            at = np.searchsorted(bounds, b.column(0).to_numpy(), "right")
            np.add.at(held, at, b.column(1).to_numpy())
            rows += np.bincount(at, minlength=n)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some]), pa.array(rows[some])], names=["bin", "held", "n"])

    counted = keys.select("_key", "_size").mapInArrow(run, "bin long, held long, n long").groupBy("bin").agg(F.sum("held"), F.sum("n"))
    held, rows = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
    for i, h, n in counted.collect():  # at most one row per bin
        held[i], rows[i] = h, n
    return held, rows


def find_splitters(keys: DataFrame, shards: int, tolerance: float, probes: int = 32, rounds: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(boundaries, goals, keys) of the shards; a shard holds the keys from one boundary to below the next.

    The key is that of the rows through which a boundary must go, -1 if it need not.
    """
    total = int(keys.agg(F.sum("_size")).first()[0] or 0)
    goal = np.array([total * (i + 1) / shards for i in range(shards - 1)])
    slack = tolerance * total / shards
    low, high = np.zeros(shards - 1, np.int64), np.full(shards - 1, np.iinfo(np.int64).max)
    best, miss = high.copy(), np.abs(total - goal)
    for _ in range(rounds):
        tried: set[int] = set()
        for i in range(shards - 1):
            if miss[i] <= slack or high[i] - low[i] < 2:
                continue
            a, b = int(low[i]), int(high[i])
            step = 1 << GROUP_BITS if b - a > 2 << GROUP_BITS else 1  # whole groups first
            tried |= {x for j in range(1, probes + 1) if a < (x := (a + (b - a) * j // (probes + 1)) // step * step) < b}
        if not tried:
            break
        bounds = np.array(sorted(tried), np.int64)
        below = np.cumsum(histogram(keys, bounds)[0])[:-1]
        for i in range(shards - 1):
            off = below - goal[i]
            j = int(np.argmin(np.abs(off)))
            if abs(off[j]) < miss[i]:
                best[i], miss[i] = bounds[j], abs(off[j])
            under, over = bounds[off <= 0], bounds[off >= 0]
            low[i] = max(low[i], under[-1]) if len(under) else low[i]
            high[i] = min(high[i], over[0]) if len(over) else high[i]
    inside = np.where((miss > slack) & (high - low < 2), low, -1)
    return np.maximum.accumulate(best), goal, inside


def refine_bins(keys: DataFrame, splitters: np.ndarray, rows_per_bin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries that hold all splitters, and bytes and rows per bin, with bins of bounded rows.

    Bins are halved into eighths as long as they are too full and hold more than one key.
    """
    edges = np.unique(splitters)
    held, rows = histogram(keys, edges)
    while True:
        lows = np.concatenate([[0], edges]).astype(np.int64)
        highs = np.concatenate([edges, [(1 << 63) - 1]]).astype(np.int64)
        more = {int(a) + (int(b) - int(a)) * j // 8 for a, b, n in zip(lows, highs, rows, strict=True) if n > rows_per_bin and b - a > 1 for j in range(1, 8)}
        new = np.unique(np.concatenate([edges, np.array(sorted(more), np.int64)]))
        if len(new) == len(edges):
            return edges, held, rows
        edges = new
        held, rows = histogram(keys, edges)


def histogram_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01, rows_per_bin: int = 0) -> DataFrame:
    """All columns of docs, with size (bytes of the text and 8), shard and slot.

    tolerance: bytes by which a boundary may miss its goal, as a share of a shard.
    Slots number the rows of a shard without gaps from 0.
    """
    keyed = docs.withColumn("size", F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long") + 8)
    keyed = keyed.withColumn("_key", shard_key(id_col, text_col))
    keys = shared_table(keyed.select("_key", F.col("size").alias("_size")), "keys")
    splitters, goal, inside = find_splitters(keys, shards, tolerance)
    hot = inside[inside >= 0]
    per_bin = rows_per_bin or max(1000, -(-keys.count() // (16 * shards)))
    edges, held, rows = refine_bins(keys, np.concatenate([splitters, hot, hot + 1]), per_bin)
    before = np.cumsum(rows) - rows  # rows before each bin, in the order of keys
    # the number of rows before each boundary; through a group of one key in proportion to the bytes that its goal leaves there
    cuts = before_key = np.concatenate([before, [rows.sum()]])[np.searchsorted(edges, splitters, "right")]
    if len(hot):
        at = np.searchsorted(edges, np.maximum(inside, 0), "right")
        part = np.clip((goal - (np.cumsum(held) - held)[at]) / np.maximum(held[at], 1), 0, 1)
        cuts = np.where(inside >= 0, before[at] + np.rint(part * rows[at]).astype(np.int64), before_key)
    cuts = np.maximum.accumulate(cuts)
    starts = np.concatenate([[0], cuts])

    @F.pandas_udf("int")
    def bin_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(), "right").astype(np.int32))

    @F.pandas_udf("shard int, slot long")
    def place(bin_: pd.Series, rank: pd.Series) -> pd.DataFrame:
        row = before[bin_.to_numpy()] + rank.to_numpy()
        shard = np.searchsorted(cuts, row, "right")
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": row - starts[shard]})

    placed = keyed.withColumn("_bin", bin_of("_key"))
    crowded = np.flatnonzero(rows > per_bin).tolist()  # bins of one key
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy("_key", id_col)) - 1
    ranked = placed.where(~F.col("_bin").isin(crowded)).withColumn("_rank", rank.cast("long"))
    if crowded:
        salts = int(-(-rows[crowded].max() // per_bin))
        group = placed.where(F.col("_bin").isin(crowded)).withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)))
        group = shared_table(group, "crowded")
        order = Window.partitionBy("_bin").orderBy("_salt")  # of `salts` rows a bin
        base = group.groupBy("_bin", "_salt").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.sum("_n").over(order) - F.col("_n")).drop("_n")
        rank = F.row_number().over(Window.partitionBy("_bin", "_salt").orderBy(F.lit(1))) - 1
        many = group.withColumn("_rank", rank).join(base, ["_bin", "_salt"]).withColumn("_rank", (F.col("_rank") + F.col("_base")).cast("long"))
        ranked = ranked.unionByName(many.drop("_salt", "_base"))
    out = ranked.withColumn("_p", place("_bin", "_rank"))
    return out.withColumn("slot", F.col("_p.slot")).withColumn("shard", F.col("_p.shard")).drop("_p", "_bin", "_key", "_rank")
