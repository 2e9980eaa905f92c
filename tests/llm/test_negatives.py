"""Operator 11 against all scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from traitscan.llm import negatives, queries
from traitscan.llm.negatives import mine_hard_negatives

ROW = "id long, label int, values array<long>, anchor boolean, score string"


def brute(rows, n_pos=5, n_neg=10, low=30, high=90):
    limit = lambda v: int(np.floor(np.sqrt(2.0**61 / max(len(v), 1)) / 100))
    good = [(k, *r[:4]) for k, r in enumerate(rows) if r[1] is not None and r[2] is not None and all(x is not None and abs(x) <= limit(r[2]) for x in r[2])]
    out = []
    for k, i, label, v, anchor in good:
        if not anchor:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j is None, j, m, lab) for m, j, lab, w, _ in good if len(w) == len(v) and m != k)
        for pos in [s for s in scored if s[4] == label][:n_pos]:
            fits = [s for s in scored if s[4] != label and low * -pos[0] <= 100 * -s[0] <= high * -pos[0]][:n_neg]
            out += [(i, pos[2], r, s[2], -pos[0], -s[0]) for r, s in enumerate(fits, 1)]
    return out


def sortable(rows):
    return sorted([tuple((x is None, x) for x in r) for r in rows])


def random_rows(seed, n=260, dim=6, ids=None):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-60, 60, (12, dim))
    values = centres[rng.integers(0, 12, n)] + rng.integers(-12, 13, (n, dim))
    return [(ids(i) if ids else i, int(rng.integers(0, 4)), values[i].tolist(), bool(i % 9 == 0), "clash") for i in range(n)]


@pytest.mark.parametrize("blocks", [(8192, 4096), (50, 7)])
def test_all_scores(spark, blocks):
    rows = random_rows(1)
    got = mine_hard_negatives(spark.createDataFrame(rows, ROW).repartition(3), F.col("anchor"), block_rows=blocks[0], anchor_rows=blocks[1])
    assert sortable(got.collect()) == sortable(brute(rows))


def test_awkward_rows(spark):
    rows = random_rows(2, 120, 3)
    rows += [(None, 1, [5, 5, 5], True, "x"), (None, 2, [4, 4, 4], False, "x"), (7, 1, [9, 9, 9], True, None), (7, 1, [9, 9, 9], True, None)]  # null and repeated ids
    rows += [(500, None, [1, 2, 3], True, ""), (501, 1, None, True, ""), (502, 1, [1, None, 3], True, ""), (503, 1, [1 << 60, 1, 1], True, ""), (504, 1, [1, 2], True, ""), (505, 2, [1, 1], False, ""), (506, 1, [2, 2], False, "")]
    rows += [(600, 1, [], True, ""), (601, 1, [], False, ""), (602, 2, [], False, ""), (603, 3, [], None, ""), (700, 9, [1, 1, 1], True, "")]  # empty vectors, a label of one row
    rows += [(800 + i, 1, [30, 30, 30], i == 0, "") for i in range(30)] + [(900 + i, 2, [20, 20, 20], False, "") for i in range(30)]  # ties beyond ten
    got = mine_hard_negatives(spark.createDataFrame(rows, ROW), F.col("anchor"), block_rows=40, anchor_rows=5)
    assert sortable(got.collect()) == sortable(brute(rows))
    big = [(i, i % 2, [(1 << 20) * (i + 1), 3], i < 3, "") for i in range(40)]  # beyond exact floats of 32 bits
    assert sortable(mine_hard_negatives(spark.createDataFrame(big, ROW), F.col("anchor")).collect()) == sortable(brute(big))
    assert mine_hard_negatives(spark.createDataFrame([], ROW), F.col("anchor")).count() == 0


def test_certified_windows_end_the_search():
    """On clustered vectors a search stops before it has seen all cells, with the same result."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (16, 8))
    values = (centres[rng.integers(0, 16, 4000)] + rng.integers(-3, 4, (4000, 8))).astype(np.int64)
    rows = {"nid": np.arange(4000), "id": np.arange(4000), "has_id": np.ones(4000, bool), "label": rng.integers(0, 3, 4000), "values": values}
    books = (negatives.codebook(values[:, :4].astype(float)), negatives.codebook(values[:, 4:].astype(float)))
    index = negatives.MultiIndex(rows, books)
    seen = []
    plain = index.visit

    def counted(one, two):
        last = np.inf
        for bound, s, e in plain(one, two):
            assert bound <= last
            last = bound
            seen.append(e - s)
            yield bound, s, e

    index.visit = counted
    anchors = {k: v[:50] for k, v in rows.items()}
    got = negatives.search_block(index, anchors, 5, True, 0, 0)
    for i in range(50):
        same = [(-int(values[i] @ values[j]), j) for j in np.flatnonzero(rows["label"] == rows["label"][i]) if j != i]
        assert got["row"][got["anchor"] == i].tolist() == [j for _, j in sorted(same)[:5]]
    assert sum(seen) < 0.5 * 50 * 4000
    assert sum(e - s for _, s, e in plain(*(b[0] for b in index.bounds(values[:1])))) == 4000


def test_query_reads_the_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    made = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(x))) for x in r.embedding], r.vec_id % 100 == 0) for r in rows]
    got = queries.op11_negatives(spark, DATA).collect()
    assert sortable(got) == sortable(brute(made))
