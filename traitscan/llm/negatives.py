"""Operator 11: hard negatives by an inverted multi-index.

Vectors of integers are dealt to blocks by a hash of their row. A codebook for
each half of the dimensions, learned from at most SAMPLE_ROWS rows, puts every row
of a block into a cell, a pair of codes; the block keeps, for each code, the
radius that covers its rows' halves. For an anchor, a half's score is at most
code . anchor half + radius x length of the anchor half. A heap visits cells in
the order of the summed bounds of their halves (multi-sequence), and a search ends
when its k-th score lies above the next cell's bound: what it has found is then
certified. Whatever the codebooks are, results are exact.

First each anchor's best rows of its own label are found (the positives), then,
for each positive, the best rows of other labels in its window of scores. Blocks
of anchors and blocks of rows meet in tasks of bounded size, once per phase; a
task returns k rows per anchor and window, and Spark keeps the best k of all.

Cases: rows with a null label, a null vector, a null component, or a component
so large that an inner product might not fit a long take no part; neither do null
anchor flags. Vectors of different length never meet; empty vectors have the score
0 with each other. Equal scores are ordered by the smaller id, null ids last, then
by row. Repeated ids are rows of their own: an anchor's row is excluded by row, not
by id, and every anchor row gives its own results. An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitscan.llm.common import shared_table

#: Rows of a block, and anchors of a block, about.
BLOCK_ROWS, ANCHOR_ROWS = 8192, 4096
#: Rows from which the codebooks are learned, at most.
SAMPLE_ROWS = 8192
CODES, ROUNDS = 16, 8


def codebook(halves: np.ndarray, codes: int = CODES, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of the sampled halves by Lloyd's rounds, from the first different rows on."""
    if not halves.shape[1]:
        return np.zeros((1, 0))
    seeds = np.unique(halves, axis=0, return_index=True)[1]
    centres = halves[np.sort(seeds)[:codes]]
    for _ in range(rounds):
        near = nearest(halves, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, halves)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (0.5 * (centres * centres).sum(axis=1) - x @ centres.T).argmin(axis=1)


class MultiIndex:
    """Rows of one block, sorted by cell, with the radii of its codes."""

    def __init__(self, rows: dict[str, np.ndarray], books: tuple[np.ndarray, np.ndarray]):
        values = rows["values"].astype(np.float64)
        half = values.shape[1] // 2
        self.parts = (slice(0, half), slice(half, None))
        self.books = books
        codes = [nearest(values[:, p], b) for p, b in zip(self.parts, books, strict=True)]
        self.radii = []
        for p, b, c in zip(self.parts, books, codes, strict=True):
            far = np.full(len(b), -np.inf)
            np.maximum.at(far, c, np.sqrt(((values[:, p] - b[c]) ** 2).sum(axis=1)))
            self.radii.append(far)
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.argsort(cell, kind="stable")
        self.starts = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1)).tolist()
        self.rows = {k: v[order] for k, v in rows.items()}
        self.most = float(np.sqrt((values * values).sum(axis=1)).max(initial=0))

    def bounds(self, anchors: np.ndarray) -> list[np.ndarray]:
        """For each half, the most that a row of each code can add to each anchor's score."""
        out = []
        for p, b, r in zip(self.parts, self.books, self.radii, strict=True):
            q = anchors[:, p].astype(np.float64)
            length = np.sqrt((q * q).sum(axis=1))[:, None]
            slack = 1e-9 * (1 + length * (np.maximum(r, 0) + np.sqrt((b * b).sum(axis=1))))  # for rounding
            out.append(np.where(np.isfinite(r), q @ b.T + length * np.maximum(r, 0) + slack, -np.inf))
        return out

    def visit(self, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, first row, end) of the cells that have rows, by falling bound of the sum of both halves."""
        first, second = np.argsort(-one, kind="stable").tolist(), np.argsort(-two, kind="stable").tolist()
        one, two, starts, width = one.tolist(), two.tolist(), self.starts, len(two)
        heap = [(-(one[first[0]] + two[second[0]]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound == np.inf:
                return
            cell = first[i] * width + second[j]
            if starts[cell] < starts[cell + 1]:
                yield -bound, starts[cell], starts[cell + 1]
            if j + 1 < width:
                heapq.heappush(heap, (-(one[first[i]] + two[second[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-(one[first[i + 1]] + two[second[0]]), i + 1, 0))


class Best:
    """The k best rows so far of one window of scores, low <= 100 * score <= high."""

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf):
        self.k, self.low, self.high = k, low, high
        self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ties: np.ndarray) -> None:
        """Rows with a place in the ties' order; keeps the first k by score, then tie."""
        if np.isfinite(self.low):
            fits = (100 * scores >= self.low) & (100 * scores <= self.high)
            rows, scores = rows[fits], scores[fits]
        if len(self.rows) == self.k and len(rows):
            fits = scores >= self.scores[-1]
            rows, scores = rows[fits], scores[fits]
        elif len(rows) > 4 * self.k:
            fits = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            rows, scores = rows[fits], scores[fits]
        if not len(rows):
            return
        rows, scores = np.concatenate([self.rows, rows]), np.concatenate([self.scores, scores])
        order = np.lexsort((ties[rows], -scores))[: self.k]
        self.rows, self.scores = rows[order], scores[order]

    def certified(self, bound: float) -> bool:
        """Whether rows with a score of at most `bound` can change nothing."""
        return self.high < self.low or 100 * bound < self.low or (len(self.rows) == self.k and self.scores[-1] > bound)


def search_block(index: MultiIndex, anchors: dict[str, np.ndarray], k: int, same: bool, low: int, high: int) -> dict[str, np.ndarray]:
    """(anchor, window, row, id, has_id, score) of the block's best rows for each anchor and window.

    same: rows of the anchor's label, one window without ends; else rows of other
    labels, a window for each of the anchor's positives' scores.
    """
    rows, values = index.rows, index.rows["values"]
    q = anchors["values"]
    lengths = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    exact = float(lengths.max(initial=0)) * index.most
    kind = np.float32 if exact < 1 << 24 else np.float64 if exact < 1 << 53 else np.int64  # partial sums are below the product of the lengths
    values, q = values.astype(kind), q.astype(kind)
    ties = np.empty(len(values), np.int64)
    ties[np.lexsort((rows["nid"], rows["id"], ~rows["has_id"]))] = np.arange(len(values))
    one, two = index.bounds(anchors["values"])
    step = max(256, len(values) // 8)
    out: list[tuple] = []
    for i in range(len(q)):
        best = [Best(k)] if same else [Best(k, low * int(p), high * int(p)) for p in anchors["scores"][i][: anchors["n"][i]]]
        label, open_ = anchors["label"][i], best
        spans, held = [], 0

        def take(i: int = i, label: int = label) -> None:
            at = np.concatenate([np.arange(s, e) for s, e in spans])
            of = rows["label"][at] == label
            if same:
                of &= rows["nid"][at] != anchors["nid"][i]
            else:
                of = ~of
            found = np.concatenate([values[s:e] @ q[i] for s, e in spans])[of].astype(np.int64)
            for b in open_:
                b.add(at[of], found, ties)

        for bound, s, e in index.visit(one[i], two[i]):
            if held >= step:
                take()
                spans, held = [], 0
                open_ = [b for b in open_ if not b.certified(bound)]
            if not open_ or not held and all(b.certified(bound) for b in open_):
                spans = []
                break
            spans.append((s, e))
            held += e - s
        if spans and open_:
            take()
        for w, b in enumerate(best):
            out += [(i, w, r, s) for r, s in zip(b.rows.tolist(), b.scores.tolist(), strict=True)]
    a, w, r, s = (np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
    return {"anchor": anchors["nid"][a], "window": w, "row": rows["nid"][r], "id": rows["id"][r], "has_id": rows["has_id"][r], "score": s}


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **columns)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as f:
        return {k: f[k] for k in f.files}


def _columns(t: pa.Table, dim: int) -> dict[str, np.ndarray]:
    """The columns of a block in the order of its rows' numbers."""
    t = t.sort_by("nid")
    values = t.column("values").combine_chunks()
    values = np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(t.num_rows, dim)
    small = np.abs(values).max(initial=0) < 1 << 15
    ids = t.column("id")
    out = {"nid": t.column("nid").to_numpy(), "id": ids.fill_null(0).to_numpy(), "has_id": ids.is_valid().to_numpy(), "label": t.column("label").to_numpy(), "values": values.astype(np.int16) if small else values}
    if "scores" in t.column_names:
        lists = t.column("scores").to_pylist()
        out["n"] = np.array([len(x) for x in lists], np.int64)
        out["scores"] = np.array([x + [0] * (max(map(len, lists)) - len(x)) for x in lists], np.int64).reshape(t.num_rows, -1)
    return out


def _blocks(rows: DataFrame, per_block: int, total: int) -> tuple[DataFrame, int]:
    """Rows packed into blocks (dim, block, data), dealt by a hash of the row, and the number of blocks."""
    n = max(1, -(-total // per_block))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([_pack(_columns(t, key[0].as_py()))], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("nid"), F.lit(n)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, data binary"), n


FOUND = "anchor long, window int, row long, id long, score long"


def _search(index: DataFrame, blocks: int, anchors: DataFrame, books: dict[int, tuple[np.ndarray, np.ndarray]], k: int, same: bool, low: int = 0, high: int = 0) -> DataFrame:
    """The best k rows of every anchor and window, over all blocks."""
    sides = anchors.select(F.col("block").alias("ablock"), "dim", F.col("data").alias("anchors"))
    numbers = shared_table(index.select("dim", "block").join(sides.select("dim", "ablock"), "dim"), "blocknumbers")  # of blocks, not of rows
    left = index.join(numbers, ["dim", "block"])
    right = sides.join(numbers, ["dim", "ablock"])
    key = ["dim", "block", "ablock"]

    def search(t: pa.Table, a: pa.Table) -> pa.Table:
        if t.num_rows and a.num_rows:
            rows = _unpack(t.column("data")[0].as_py())
            dim = t.column("dim")[0].as_py()
            none = tuple(np.zeros((1, n)) for n in (dim // 2, dim - dim // 2))
            found = search_block(MultiIndex(rows, books.get(dim, none)), _unpack(a.column("anchors")[0].as_py()), k, same, low, high)
        else:
            found = dict.fromkeys(("anchor", "window", "row", "id", "has_id", "score"), np.zeros(0, np.int64))
        ids = pa.array(found["id"], pa.int64(), mask=found["has_id"] == 0)
        return pa.table([pa.array(found["anchor"], pa.int64()), pa.array(found["window"], pa.int32()), pa.array(found["row"], pa.int64()), ids, pa.array(found["score"], pa.int64())], names=["anchor", "window", "row", "id", "score"])

    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, FOUND)
    first = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def mine_hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "id", label_col: str = "label", vector_col: str = "values", n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for integer vectors.

    A negative of a positive has another label and low * positive score <= 100 *
    its score <= high * positive score. Ids and labels are integers.
    """
    v = F.col("values")
    base = rows.select(F.monotonically_increasing_id().alias("nid"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<long>").alias("values"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    most = F.floor(F.sqrt(F.lit(2.0**61) / F.greatest(F.size(v), F.lit(1))) / 100)
    fits = F.forall(v, lambda x: x.isNotNull() & (x <= most) & (x >= -most))
    base = base.where(F.col("label").isNotNull() & v.isNotNull()).where(F.coalesce(fits, F.lit(False))).withColumn("dim", F.size(v))
    base = shared_table(base, "minedrows")
    sizes = base.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_anchor").cast("long")).alias("a")).first()
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sample: dict[int, list] = {}
    for r in base.orderBy(F.xxhash64("nid"), "nid").limit(SAMPLE_ROWS).select("dim", "values").collect():
        sample.setdefault(r.dim, []).append(r["values"])
    for dim, x in sample.items():
        x = np.array(x, np.float64).reshape(len(x), dim)
        books[dim] = (codebook(x[:, : dim // 2]), codebook(x[:, dim // 2 :]))
    index, blocks = _blocks(base.select("dim", "nid", "id", "label", "values"), block_rows, sizes.n)
    index = shared_table(index, "minedindex")
    chosen = base.where("is_anchor")
    anchors, _ = _blocks(chosen.select("dim", "nid", "id", "label", "values"), anchor_rows, sizes.a or 0)
    positives = shared_table(_search(index, blocks, shared_table(anchors, "anchors"), books, n_positives, same=True), "positives")
    scores = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("s"))  # n_positives at most
    scored = chosen.join(scores.select(F.col("anchor").alias("nid"), F.col("s.score").alias("scores")), "nid")
    asked, _ = _blocks(scored.select("dim", "nid", "id", "label", "values", "scores"), anchor_rows, sizes.a or 0)
    negatives = _search(index, blocks, shared_table(asked, "asked"), books, n_negatives, same=False, low=low, high=high)
    pairs = positives.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = pairs.join(chosen.select(F.col("nid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return negatives.join(pairs, ["anchor", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
