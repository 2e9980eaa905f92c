"""Scans with carries and peaks across blocks against plain loops."""

import math
import random

import pytest

from traitscan.operators import ordered


def plain_scan(rows, reverse):
    out = []
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: r[1], reverse=reverse)
        total = most = last = None
        product, seen = 1.0, False
        for k, r in enumerate(mine):
            v = r[2]
            diff = None if k == 0 or v is None or last is None else v - last
            if v is not None:
                total, most, product, seen = (total or 0.0) + v, v if most is None else max(most, v), product * v, True
            out.append((s, r[1], total, product if seen else None, most, diff))
            last = v
    return out


def close(a, b):
    key = lambda r: (r[0] is None, str(r[0]), r[1])
    a, b = sorted(a, key=key), sorted(b, key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:2] == y[:2]
        for p, q in zip(x[2:], y[2:], strict=True):
            assert (p is None) == (q is None) and (p is None or math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9)), (x, y)


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("ranges", [0, 40])
def test_scan(spark, reverse, ranges):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), k, rng.choice([None, -1.5, 0.5, 2.0, -0.25, 1.0])) for k in range(400)]
    rows += [("zero", k, float(k - 3)) for k in range(8)] + [("none", 1, None), ("none", 2, None)]
    df = spark.createDataFrame(rows, "s string, k long, v double").repartition(5)
    got = ordered.scan(df, "v", ["s"], ["k"], reverse=reverse, range_rows=ranges)
    close([tuple(r[c] for c in ("s", "k", "cum_sum", "cum_prod", "cum_max", "diff")) for r in got.collect()], plain_scan(rows, reverse))
    whole = ordered.scan(df.where("k < 350 and v is not null").dropDuplicates(["k"]), "v", [], ["k"], range_rows=30)
    assert whole.columns == ["s", "k", "v", "cum_sum", "cum_prod", "cum_max", "diff"] and whole.count() > 200
    assert ordered.scan(df.limit(0), "v", ["s"], ["k"], range_rows=ranges).count() == 0


def plain_peaks(rows, apart):
    kept = []
    for s in {r[0] for r in rows}:
        mine = sorted(((r[1], r[2]) for r in rows if r[0] == s))
        some = [(p, v) for k, (p, v) in enumerate(mine) if (k == 0 or v > mine[k - 1][1]) and (k == len(mine) - 1 or v >= mine[k + 1][1])]
        chosen = []
        for p, _ in sorted(some, key=lambda x: (-x[1], x[0])):
            if all(abs(p - q) >= apart for q in chosen):
                chosen.append(p)
        kept += [(s, p) for p in chosen]
    return sorted(kept, key=str)


@pytest.mark.parametrize("apart", [0, 2, 5, 40])
def test_peaks_across_blocks(spark, apart):
    rng = random.Random(apart)
    rows = [("a", k, float(rng.randint(0, 30))) for k in range(0, 1200)] + [("b", 10 * k, float(k if k % 2 else 0)) for k in range(60)] + [(None, 1, 5.0)]  # b: a chain in which each peak hangs on the next
    df = spark.createDataFrame(rows, "s string, k long, v double").repartition(3)
    for block in (15, 50_000):
        got = ordered.find_peaks(df, "v", "k", "s", apart, block_rows=block)
        assert sorted(((r.s, r.k) for r in got.collect()), key=str) == plain_peaks(rows, apart)
    assert ordered.find_peaks(df.limit(0), "v", "k", "s", apart).count() == 0
