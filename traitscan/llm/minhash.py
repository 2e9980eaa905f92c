"""Operator 8: near-duplicates by one-permutation MinHash with optimal densification.

One hash per shingle fills all bins of a signature; an empty bin copies the
first filled bin in its own random order of bins. Bins are banded; documents
that share a band bucket are candidates. A bucket gives a star: every member is
compared with its least member only. Stars are confirmed on the full shingle
sets and their components found; more rounds of stars with other centres follow.
Where a bucket then still holds members of different components, all members of
such buckets that hang together are compared across components in tasks of
bounded size (never inside one component), by counting common shingles through
inverted lists; a shingle that most members hold is counted by those that lack
it. So a star cannot hide a link, a pair is looked at once however many buckets
it shares, and no pair leaves a task but those that join components. Documents
with equal sets are one node.

Cases: a null or empty text has no shingles and links with nothing; a null id is
a node of its own, kept, with a null component unless it has linked rows with an
id; repeated rows are copies of each other; a set is hashed whole, however long
the text; extra columns are ignored.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscan.llm.bpe import batches_of, forget
from traitscan.llm.common import broadcast_if_small, connected_components, drop_shared, shared_table, small_batches

BANDS, ROWS = 56, 7
#: Shingles of one side of a task that compares documents across components.
TASK_SHINGLES = 1_000_000
#: List entries that such a task counts at once; about 40 bytes each.
COUNT_ENTRIES = 1_000_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit integers."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = pow(_BASE, -1, 1 << 64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", _BASE), ("down", self.inverse)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = Powers()


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte) of every word of lower-cased UTF-8 bytes."""
    white = _WHITE[data]
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _POWERS.upto(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[: len(data)])])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's `width`-word shingles.

    A text with fewer words has its whole sequence as its only shingle.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = b" ".join(raw)
    data = np.frombuffer(joined, np.uint8)
    h, starts = word_hashes(data) if len(data) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    cuts = np.searchsorted(starts, begins)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        w = h[a:b]
        n = min(width, len(w))
        if n == 0:
            out.append(w)
            continue
        s = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            s = mix(s * _U(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
        out.append(np.unique(s))
    return out


class OnePermutation:
    """Signatures and band keys of sorted sets of 64-bit hashes."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 11):
        self.bands, self.rows, k = bands, rows, bands * rows
        self.k = k
        rng = np.random.Generator(np.random.PCG64(seed))
        self.order = np.argsort(rng.random((k, k)), axis=1).astype(np.int16)  # order[i][j]: when bin i tries bin j
        self.salt = rng.integers(1, 1 << 63, (bands, rows), dtype=np.uint64) * _U(2) + _U(1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        bins = ((hashes >> _U(32)) * _U(self.k) >> _U(32)).astype(np.int64)  # rises with the hash
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        full = bins[first]
        out = np.zeros(self.k, np.uint64)
        out[full] = hashes[first]
        if len(full) < self.k:
            hole = np.ones(self.k, bool)
            hole[full] = False
            empty = np.flatnonzero(hole)
            out[empty] = out[full[np.argmin(self.order[np.ix_(empty, full)], axis=1)]]
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """(documents, bands) keys of (documents, k) signatures; the band is part of the key."""
        s = signatures.reshape(len(signatures), self.bands, self.rows)
        return mix((mix(s) * self.salt).sum(axis=2, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + _U(77))).view(np.int64)) if len(s) else 0


def sketch(docs: DataFrame, width: int, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: nid, id, hash of the text, n, fingerprint (f1, f2) and band keys."""
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    numbered = docs.select(F.monotonically_increasing_id().alias("nid"), F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        oph = OnePermutation(bands, rows)
        for b in batches:
            texts = b.column(3).to_pylist()
            for lo, hi in batches_of(texts):
                sets = shingle_sets(texts[lo:hi], width)
                n = np.array([len(s) for s in sets], np.int64)
                f1, f2 = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2).T
                some = np.flatnonzero(n)
                keys = oph.band_keys(np.stack([oph.signature(sets[i]) for i in some])) if len(some) else np.zeros((0, bands), np.int64)
                ends = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(n), pa.array(f1), pa.array(f2), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                    names=["nid", "id", "th", "n", "f1", "f2", "bands"],
                )

    return numbered.mapInArrow(run, f"nid long, id {id_type}, th long, n long, f1 long, f2 long, bands array<long>")


def sets_of(ends: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(nid, s): the whole shingle sets of the given nodes.

    Only their documents are read again; they are found by id and hash of the
    text, so rows without an id or with one id do not all meet, and checked by
    the fingerprint of their set.
    """
    wanted = shared_table(nodes.join(broadcast_if_small(ends), "nid").select("nid", "id", "th", "f1", "f2"), "wanted")
    rows = wanted.count()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).withColumn("_th", F.xxhash64("text"))
    texts = texts.join(F.broadcast(wanted) if rows <= 500_000 else wanted, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")))  # 40 bytes a row

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, f1, f2 = b.column(1).to_pylist(), b.column(2).to_numpy(), b.column(3).to_numpy()
            for lo, hi in batches_of(texts):
                sets = shingle_sets(texts[lo:hi], width)
                mine = np.array([fingerprint(s) == (x, y) for s, x, y in zip(sets, f1[lo:hi], f2[lo:hi], strict=True)], bool)  # an id may be repeated with another text
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).filter(pa.array(mine)), pa.array([s.tobytes() for s, m in zip(sets, mine, strict=True) if m], pa.binary())], names=["nid", "s"])

    sets = shared_table(texts.select("nid", "text", "f1", "f2").mapInArrow(hashed, "nid long, s binary"), "sets")
    drop_shared(wanted)
    if sets.count() > rows:  # copies that also share their id
        sets = shared_table(sets.groupBy("nid").agg(F.first("s").alias("s")), "sets")
    return sets


def common_counts(x: list[np.ndarray], y: list[np.ndarray]):  # noqa: ANN201
    """(first row of x, matrix of common shingles with all of y) for ranges of rows of x."""
    sizes = [len(v) for v in y]
    owner, h = np.repeat(np.arange(len(y)), sizes), np.concatenate(y)
    names, at, df = np.unique(h, return_inverse=True, return_counts=True)
    most = 2 * df > len(y)  # lists of those that lack the shingle
    row = np.cumsum(most) - 1
    lacks = np.ones((int(most.sum()), len(y)), bool)
    of = most[at]
    lacks[row[at[of]], owner[of]] = False
    gone, who = np.nonzero(lacks)
    key = np.concatenate([at[~of], np.flatnonzero(most)[gone]])
    order = np.argsort(key, kind="stable")
    lists = np.concatenate([owner[~of], who])[order]
    first = np.searchsorted(key[order], np.arange(len(names) + 1))
    mine = []
    for v in x:
        k = np.minimum(np.searchsorted(names, v), len(names) - 1)
        mine.append(k[names[k] == v])
    base = np.array([int(most[k].sum()) for k in mine])
    cost = np.array([int((first[k + 1] - first[k]).sum()) for k in mine]) + len(y)
    begin = 0
    while begin < len(x):
        end = begin + max(1, int(np.searchsorted(np.cumsum(cost[begin:]), COUNT_ENTRIES, "right")))
        k = np.concatenate(mine[begin:end])
        n = first[k + 1] - first[k]
        places = np.arange(n.sum()) + np.repeat(first[k] - np.cumsum(n) + n, n)
        to = np.repeat(np.repeat(np.arange(end - begin), [len(v) for v in mine[begin:end]]) * len(y), n) + lists[places]
        sign = np.repeat(np.where(most[k], -1.0, 1.0), n)
        found = np.bincount(to, sign, (end - begin) * len(y)).reshape(end - begin, len(y))
        yield begin, found.astype(np.int64) + base[begin:end, None]
        begin = end


def joined_roots(t: pa.Table, percent: int) -> set[tuple[int, int]]:
    """Pairs of roots that links between the rows (nid, r, s, side) of one task join; a forest.

    Rows of side 1 are compared with those of side 2; with side 0 all rows are
    compared, those of the most frequent root only with others.
    """
    r, side = t.column("r").to_numpy(), t.column("side").to_numpy()
    sets = [np.frombuffer(v, np.uint64) for v in t.column("s").to_pylist()]
    if side[0] == 0:
        roots, n = np.unique(r, return_counts=True)
        left, right = np.flatnonzero(r != roots[np.argmax(n)]), np.arange(len(r))
    else:
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    parent: dict[int, int] = {}

    def top(v: int) -> int:
        while parent.get(v, v) != v:
            v = parent[v]
        return v

    found = set()
    if not len(left) or not len(right):
        return found
    size = np.array([len(v) for v in sets])
    for at, both in common_counts([sets[i] for i in left], [sets[i] for i in right]):
        rows = left[at : at + len(both)]
        link = (100 * both >= percent * (size[rows][:, None] + size[right] - both)) & (r[rows][:, None] != r[right])
        i, j = np.nonzero(link)
        for a, b in set(zip(r[rows[i]].tolist(), r[right[j]].tolist(), strict=True)):
            u, v = top(a), top(b)
            if u != v:
                parent[max(u, v)] = min(u, v)
                found.add((a, b))
    return found


def links_across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b, ra, rb) between the roots of bucket rows (key, nid, n, r) that join components.

    Roots that hang together through buckets are a cluster. Clusters that fit in
    a task share tasks; a larger one is cut into blocks, and pairs of blocks are
    tasks. A root of more than a block has blocks of its own, which are not
    compared with each other.
    """
    low = rows.groupBy("key").agg(F.min("r").alias("low"))
    cluster = connected_components(rows.join(low, "key").select("r", "low").distinct(), "r", "low").select(F.col("node").alias("r"), F.col("root").alias("cluster"))
    members = shared_table(rows.select("nid", "n", "r").distinct().join(broadcast_if_small(cluster), "r"), "members")
    roots = members.groupBy("cluster", "r").agg(F.sum("n").alias("rn"))
    roots = roots.withColumn("own", F.when(F.col("rn") > TASK_SHINGLES, F.col("r")).otherwise(F.lit(-1)))
    parts = roots.groupBy("cluster", "own").agg(F.sum("rn").alias("pn"))
    totals = parts.groupBy("cluster").agg(F.sum("pn").alias("cn"))
    parts = parts.join(totals, "cluster").withColumn("blocks", F.ceil(F.col("pn") / TASK_SHINGLES).cast("int"))
    placing = shared_table(roots.join(parts, ["cluster", "own"]).select("r", "own", "blocks", "cn"), "roots")
    placed = members.join(broadcast_if_small(placing), "r")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int")).join(sets, "nid")

    def compare(t: pa.Table) -> pa.Table:
        found = []
        cluster = t.column("cluster").to_numpy()
        for c in np.unique(cluster):
            found += joined_roots(t.filter(pa.array(cluster == c)), percent)
        a, b = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
        return pa.table({"a": a, "b": b, "ra": a, "rb": b})

    tasks = F.pmod(F.xxhash64("cluster"), F.lit(max(1, math.ceil((members.agg(F.sum("n")).first()[0] or 0) / TASK_SHINGLES))))
    whole = placed.where(F.col("cn") <= TASK_SHINGLES).select(tasks.alias("t"), F.lit(0).alias("o1"), F.lit(0).alias("b1"), F.lit(0).alias("o2"), F.lit(0).alias("b2"), F.lit(0).alias("side"), "cluster", "r", "s")
    blocks = parts.where(F.col("cn") > TASK_SHINGLES).select("cluster", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    one, two = (blocks.select("cluster", F.col("own").alias(f"o{k}"), F.col("block").alias(f"b{k}")) for k in "12")
    same = (F.col("o1") == F.col("o2")) & (F.col("b1") == F.col("b2"))
    pairs = one.join(two, "cluster").where("(o1 < o2 or o1 = o2 and b1 <= b2) and (o1 <> o2 or o1 = -1)")  # of blocks, not of rows
    numbers = shared_table(pairs, "blockpairs")
    pairs = broadcast_if_small(numbers)
    big = placed.where(F.col("cn") > TASK_SHINGLES).select("cluster", "own", "block", "r", "s")
    pick = lambda k: big.withColumnsRenamed({"own": f"o{k}", "block": f"b{k}"}).join(pairs, ["cluster", f"o{k}", f"b{k}"])
    cols = [F.col("cluster").alias("t"), "o1", "b1", "o2", "b2"]
    left = pick(1).select(*cols, F.when(same, 0).otherwise(1).alias("side"), "cluster", "r", "s")
    right = pick(2).where(~same).select(*cols, F.lit(2).alias("side"), "cluster", "r", "s")
    every = whole.union(left).union(right)
    links = shared_table(every.groupBy("t", "o1", "b1", "o2", "b2").applyInArrow(compare, "a long, b long, ra long, rb long"), "links")
    for table in (members, placing, numbers):
        drop_shared(table)
    return links


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b, and their roots ra, rb) whose full sets have 100 * common >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(mask) for i in (0, 1, 4, 5)], names=["a", "b", "ra", "rb"])

    # the pairs of a star share a: its set is joined last, and hot keys are left to the skew join
    full = pairs.join(sets.select(F.col("nid").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("nid").alias("a"), F.col("s").alias("sa")), "a")
    return shared_table(full.select("a", "b", "sa", "sb", "ra", "rb").mapInArrow(check, "a long, b long, ra long, rb long"), "links")


def merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """(nid, root) of all nodes that are not their own root, after links between roots."""
    if not links.limit(1).count():
        return links.select(F.col("a").alias("nid"), F.col("ra").alias("root")) if label is None else label
    new = connected_components(links, "ra", "rb").where("node <> root")
    fresh = new.select(F.col("node").alias("nid"), "root")
    if label is None:
        return shared_table(fresh, "label")
    moved = label.join(new.withColumnRenamed("root", "to"), F.col("root") == F.col("node"), "left")
    out = shared_table(moved.select("nid", F.coalesce("to", "root").alias("root")).union(fresh), "label")
    drop_shared(label)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """One row per row of docs: nid, id, n_shingles, component_id (least id), kept, first, fingerprint.

    kept: the id is the component's least; first: exactly one row of each component
    is the first. docs is read up to three times.

    rounds: star rounds (at least 1) before the buckets that still hold several
    components are compared across components. The first round's centres are the least members;
    later rounds take another member of a component in every bucket, so that the
    members of a large loose group meet many of its documents, at a cost that
    grows with the bucket and not with its square. With any number of rounds no
    link between documents that share a bucket is lost.
    """
    sk = shared_table(sketch(docs, width, id_col, text_col), "sketch")
    some = sk.where("n > 0")
    same = shared_table(some.groupBy("n", "f1", "f2").agg(F.min("nid").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1"), "same")
    copies = some.select("nid", "n", "f1", "f2").join(broadcast_if_small(same), ["n", "f1", "f2"]).where("nid <> rep").select("nid", "rep")
    copies = shared_table(copies, "copies")  # every copy but the representative

    # buckets of representatives; the first stars: the least member of every bucket
    nodes = some.select("nid", "n", "bands").join(broadcast_if_small(copies.select("nid")), "nid", "left_anti")
    members = nodes.select(F.explode("bands").alias("key"), "nid", "n")
    stars = members.groupBy("key").agg(F.min(F.struct("nid", "n")).alias("c"), F.max("nid").alias("high")).where("c.nid <> high")
    stars = shared_table(stars.select("key", F.col("c.nid").alias("cn"), F.col("c.n").alias("c_n")), "stars")
    buckets = shared_table(members.join(broadcast_if_small(stars), "key"), "buckets")
    near = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
    pairs = buckets.where("nid <> cn").where(near("n", "c_n")).select(F.col("cn").alias("a"), F.col("nid").alias("b")).distinct()
    pairs = shared_table(pairs.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb")), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
    sets = sets_of(ends, docs, sk, width, id_col, text_col)
    label = merged(None, confirm(pairs, sets, percent))
    tried, stale = pairs.select("a", "b"), [pairs]

    def mixed(rows: DataFrame) -> DataFrame:
        """Bucket rows with their roots, of buckets that hold more than one root."""
        rows = rows.select("key", "nid", "n").join(broadcast_if_small(label), "nid", "left").withColumn("r", F.coalesce("root", "nid")).drop("root")
        spread = rows.groupBy("key").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo <> hi").select("key")
        return shared_table(rows.join(broadcast_if_small(spread), "key"), "mixed")

    rest = mixed(buckets)
    for table in (same, stars, buckets, sets):
        drop_shared(table)
    if rest.limit(1).count():
        sets = sets_of(rest.select("nid").distinct(), docs, sk, width, id_col, text_col)
        for turn in range(1, rounds):
            pick = F.struct((F.col("r") == F.col("nid")).alias("single"), F.xxhash64("key", "nid", F.lit(turn)).alias("h"))
            centres = rest.groupBy("key").agg(F.min(F.struct(pick.alias("pick"), "nid", "n", "r")).alias("c"))
            rows = rest.join(centres, "key").select("nid", "n", "r", F.col("c.nid").alias("cn"), F.col("c.n").alias("c_n"), F.col("c.r").alias("cr")).where("r <> cr").where(near("n", "c_n"))
            swap = F.col("nid") < F.col("cn")
            found = rows.select(F.least("nid", "cn").alias("a"), F.greatest("nid", "cn").alias("b"), F.when(swap, F.col("r")).otherwise(F.col("cr")).alias("ra"), F.when(swap, F.col("cr")).otherwise(F.col("r")).alias("rb"))
            pairs = shared_table(found.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
            label = merged(label, confirm(pairs, sets, percent))
            tried = tried.union(pairs.select("a", "b"))
            stale += [pairs, rest]
            rest = mixed(rest)
        if rest.limit(1).count():
            label = merged(label, links_across(rest, sets, percent))
        drop_shared(sets)
    for table in [*stale, rest]:
        drop_shared(table)

    joined = sk.select("nid", "id", "n", "f1", "f2").join(broadcast_if_small(copies), "nid", "left").withColumn("node", F.coalesce("rep", "nid"))
    joined = joined.join(broadcast_if_small(label.withColumnRenamed("nid", "node")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "nid")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").select("root", F.col("m.id").alias("component_id"), F.col("m.nid").alias("first_nid"))
    multi = shared_table(least, "least")  # components of more than one row
    out = joined.join(broadcast_if_small(multi), "root", "left")
    single = F.col("first_nid").isNull()
    out = out.withColumn("component_id", F.when(single, F.col("id")).otherwise(F.col("component_id")))
    return out.select("nid", "id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), single).alias("kept"), (single | (F.col("nid") == F.col("first_nid"))).alias("first"), "f1", "f2")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate component, all columns as they were.

    Rows that repeat an id (or have none) are told apart by their sets.
    """
    found = near_duplicates(docs, width, percent, id_col, text_col)
    found = shared_table(found.select("id", "first", "f1", "f2", "n_shingles"), "found")
    ids = found.groupBy("id").agg(F.max("first").alias("stays"), F.sum(F.col("first").cast("int")).alias("firsts"), F.count(F.lit(1)).alias("n"))
    ids = shared_table(ids.where("not stays or firsts < n"), "flags")
    gone = ids.where("not stays").select(F.col("id").alias("_gone"))
    out = docs.join(broadcast_if_small(gone), F.col(id_col).eqNullSafe(F.col("_gone")), "left_anti")
    again = ids.where("stays").select(F.col("id").alias("_again"))
    if not again.limit(1).count():
        return out

    import pandas as pd  # 37 MB of a worker, needed here only

    @F.pandas_udf("n long, f1 long, f2 long")
    def marks(texts: pd.Series) -> pd.DataFrame:
        sets = shingle_sets(texts.tolist(), width)
        return pd.DataFrame([(len(x), *fingerprint(x)) for x in sets], columns=["n", "f1", "f2"])

    same = F.col(id_col).eqNullSafe(F.col("_again"))
    rows = out.join(again, same, "left_semi").withColumn("_m", marks(F.col(text_col).cast("string")))
    firsts = found.where("first and n_shingles > 0").select("id", "f1", "f2").distinct()
    some = rows.where("_m.n > 0").join(firsts.toDF("_i", "_x", "_y"), F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_m.f1") == F.col("_x")) & (F.col("_m.f2") == F.col("_y")), "left_semi")
    some = some.withColumns({"_x": F.col("_m.f1"), "_y": F.col("_m.f2")}).dropDuplicates([id_col, "_x", "_y"])
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return out.join(again, same, "left_anti").union(rows.where("_m.n = 0").select(*kept)).union(some.select(*kept))
