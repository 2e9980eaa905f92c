"""Operator 7: best-fit decreasing packing of token pieces into windows.

Documents longer than a window are first cut into full windows. Pieces of equal
length are interchangeable, so best fit decreasing needs only the count of
pieces per length (at most `window` numbers, whatever the corpus): a segment
tree indexed by remaining capacity finds the tightest open window, and a whole
group of equal windows is filled at once. The plan says for each length which
piece number goes to which window and offset; Spark numbers the pieces of each
length and looks their places up.

Cases: a null or empty text still has its closing id; ties (equal lengths) are
numbered by id and start; repeated rows, null and repeated ids each get a place of
their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitscan.llm.bpe import batches_of, word_bpe
from traitscan.llm.common import ddl, shared_table, small_batches


class CapacityTree:
    """Segment tree over remaining capacities; a leaf holds ranges of equal open windows."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.used = [0] * (2 * self.size)
        self.ranges: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, left: int, first: int, count: int, offset: int) -> None:
        """`count` windows from number `first` on, filled up to `offset`, with `left` to go."""
        if left and count:
            self.ranges.setdefault(left, []).append((first, count, offset))
            self._count(left, 1)

    def _count(self, left: int, by: int) -> None:
        i = self.size + left
        while i:
            self.used[i] += by
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of an open window that is at least `need`; 0 if none."""
        i = self.size + need
        if self.used[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return 0

    def take(self, left: int) -> tuple[int, int, int]:
        self._count(left, -1)
        return self.ranges[left].pop()


def best_fit_plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing of counts[length] pieces of each length.

    Returns runs (length, first piece number, pieces per window, first window
    number, offset): piece j of the run lies in window first + j // per, at
    offset + j % per * length.
    """
    tree, opened, runs = CapacityTree(window), 0, []
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        at, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room:
                first, count, offset = tree.take(room)
            else:
                room, offset, first = window, 0, opened
                count = -(-left // (window // length))
                opened += count
            per = room // length
            full = min(count, left // per)
            rest = min(left - full * per, per - 1) if full < count else 0
            runs.append((length, at, per, first, offset))
            tree.add(room - per * length, first, full, offset + per * length)
            if rest:
                tree.add(room - rest * length, first + full, 1, offset + rest * length)
            used = full + bool(rest)
            tree.add(room, first + used, count - used, offset)
            at += full * per + rest
            left -= full * per + rest
    return runs


def cut_documents(docs: DataFrame, path: str, window: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens) of every whole text and its closing id."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = word_bpe(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_of(texts):
                who, rows = [], []
                for i, ids in enumerate(bpe.encode(texts[lo:hi]), lo):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        who.append(i)
                        rows.append((start, len(piece) // 4, zlib.crc32(piece), n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(who)), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))],
                    names=[id_col, "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, window: int, id_col: str = "doc_id", rows_per_bucket: int = 50_000, row_col: str | None = None) -> DataFrame:
    """Add sequence_id and offset to pieces that have a `length` of at most `window`.

    `pieces` should be a written table: it is read twice. Pieces of a length are
    numbered in hash buckets, so a length that a third of the corpus shares is
    numbered by many tasks. row_col, a number of its own for every row of the
    table (it is not returned), spreads pieces without ids or of one id too.
    """
    buckets = max(16, -(-pieces.count() // rows_per_bucket))
    keyed = pieces.withColumn("_b", F.pmod(F.xxhash64(*([row_col] if row_col else [id_col, "start"])), F.lit(buckets)))
    sizes = shared_table(keyed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `window` rows
    runs = sorted(best_fit_plan(counts, window))
    length, first, per, seq, offset = (np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 5
    at = (length << 48) + first

    order = Window.partitionBy("length").orderBy("_b")
    base = sizes.withColumn("_base", F.sum("_n").over(order) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy(id_col, "start")) - 1
    numbered = keyed.withColumn("_r", rank.cast("long")).join(base, ["length", "_b"]).withColumn("_r", F.col("_r") + F.col("_base"))

    kept = [c for c in pieces.columns if c != row_col]
    names = [*kept, "_r"]
    i_len, i_r = names.index("length"), names.index("_r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = b.column(i_len).to_numpy(zero_copy_only=False), b.column(i_r).to_numpy(zero_copy_only=False)
            k = np.searchsorted(at, (n << 48) + r, "right") - 1
            j = r - first[k]
            cols = [seq[k] + j // per[k], offset[k] + j % per[k] * n]
            yield pa.RecordBatch.from_arrays([*b.columns[:i_r], *map(pa.array, cols)], names=[*kept, "sequence_id", "offset"])

    return numbered.select(*names).mapInArrow(run, ddl(pieces.select(*kept)) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Cut, then pack every document; one row per piece."""
    pieces = shared_table(cut_documents(docs, path, window, end_id).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return pack_pieces(pieces, window, row_col="_row")
