"""Operator 10: exact near-duplicate vectors by dual traversal of cover trees.

Vectors are scaled to unit length, so cosine >= c means distance <= sqrt(2 - 2c).
Each label's vectors are dealt to the nearest of a bounded number of pivots, the
tops of its cover tree; a cell's covering radius is measured over all its
vectors, and cell pairs that the radii rule out never meet. Large cells (one label
or one group of copies may hold a third of all rows) are dealt to blocks of bounded
size. A block's cover tree is built once, by inserting its vectors level by level:
nested nets with halving radii, where a vector is compared with the net of its
node only, and every node keeps the radius that covers its vectors. The block is
written as one row, with its tree. A task gets two blocks and walks both trees
together, pruning node pairs by their covering radii; what is left is compared
exactly in double precision. A task returns one row per vector with its links
there, and edges of a spanning forest instead of all pairs. Equal vectors are one
node with a count.

Cases: null, zero or non-finite vectors and null labels link with nothing and
are kept; vectors of different length never link; repeated and null ids are rows of
their own (a component of null ids alone is null, and its rows are kept); an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscan.llm.common import broadcast_if_small, connected_components, drop_shared, shared_table

BLOCK_ROWS = 2000
#: Pivots of all labels together, about, at most; they are broadcast.
MAX_PIVOTS = 4096
#: Radius from which on a node's vectors are compared one by one, and rows up to which they are.
LEAF_RADIUS = 0.25
LEAF_ROWS = 32
#: Vectors that are inserted at once.
INSERT_ROWS = 256


class CoverTree:
    """Nested nets with halving radii over unit vectors, as arrays.

    Node k has its centre's vector at row center[k], its vectors in rows
    start[k]:end[k] (in the tree's order), its covering radius, and its children in
    nodes first[k]:last[k] (none for a leaf). Node 0 is the root. `counted` is the
    number of distances that were computed.
    """

    FIELDS = ("center", "start", "end", "radius", "first", "last")

    def __init__(self, vectors: np.ndarray):
        self.counted = 0
        self.rows = np.arange(len(vectors))
        self.vectors = vectors
        nodes: list[list] = [[0, 0, len(vectors), 2.0, 0, 0]]
        self._cover(nodes[0], vectors[:1], vectors)
        levels = [2.0]
        at = 0
        while at < len(nodes):  # every pass inserts the vectors of one node into the next level's net
            center, lo, hi, radius, _, _ = nodes[at]
            level = levels[at]
            while level > LEAF_RADIUS and level / 2 >= radius:
                level /= 2
            if hi - lo > LEAF_ROWS and level > LEAF_RADIUS:
                mine = self.rows[lo:hi]
                net, member, far = self.insert(vectors, mine, center, level / 2)
                order = np.argsort(member, kind="stable")
                self.rows[lo:hi] = mine[order]
                ends = lo + np.cumsum(np.bincount(member, minlength=len(net)))
                cover = np.zeros(len(net))
                np.maximum.at(cover, member, far)
                nodes[at][4:] = [len(nodes), len(nodes) + len(net)]
                starts = np.concatenate([[lo], ends[:-1]])
                nodes += [[c, s, e, r, 0, 0] for c, s, e, r in zip(net.tolist(), starts.tolist(), ends.tolist(), cover.tolist(), strict=True)]
                levels += [level / 2] * len(net)
            at += 1
        table = list(zip(*nodes, strict=True))
        self.center, self.start, self.end = (np.array(table[k], np.int64) for k in (0, 1, 2))
        self.radius = np.array(table[3])
        self.first, self.last = (np.array(table[k], np.int64) for k in (4, 5))

    def _cover(self, node: list, center: np.ndarray, vectors: np.ndarray) -> None:
        self.counted += len(vectors)
        node[3] = float(distances(center, vectors).max(initial=0.0))

    def insert(self, vectors: np.ndarray, mine: np.ndarray, center: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(net, net place of each row, its distance): rows farther than radius from the net so far join it."""
        net = [center]
        member, far = np.zeros(len(mine), np.int64), np.zeros(len(mine))
        for lo in range(0, len(mine), INSERT_ROWS):
            some = mine[lo : lo + INSERT_ROWS]
            d = distances(vectors[some], vectors[net])
            self.counted += d.size
            near = d.argmin(axis=1)
            best = d[np.arange(len(some)), near]
            left = np.flatnonzero(best > radius)
            if len(left):
                among = distances(vectors[some[left]], vectors[some[left]])
                self.counted += among.size
                open_ = np.ones(len(left), bool)
                for k in range(len(left)):
                    if open_[k]:
                        took = open_ & (among[k] <= radius)
                        took[k] = True
                        near[left[took]], best[left[took]] = len(net), among[k][took]
                        best[left[k]] = 0.0
                        net.append(int(some[left[k]]))
                        open_ &= ~took
            member[lo : lo + len(some)], far[lo : lo + len(some)] = near, best
        return np.array(net), member, far

    def pack(self) -> dict[str, np.ndarray]:
        return {f"tree_{k}": getattr(self, k) for k in self.FIELDS} | {"tree_rows": self.rows}

    @classmethod
    def unpack(cls, columns: dict[str, np.ndarray], vectors: np.ndarray) -> CoverTree:
        tree = cls.__new__(cls)
        for k in cls.FIELDS:
            setattr(tree, k, columns[f"tree_{k}"])
        tree.rows, tree.vectors, tree.counted = columns["tree_rows"], vectors, 0
        return tree


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x @ y.T
    d *= -2.0
    d += 2.0
    np.maximum(d, 0.0, out=d)
    return np.sqrt(d, out=d)


def dual_traversal(a: CoverTree, b: CoverTree, reach: float, cosine: float):  # noqa: ANN201
    """Pairs of leaves of a and b that may hold pairs within `reach`, as (rows, rows, whether they are pairs already).

    Leaves of one vector each are compared by the distance of their centres; they
    come together, as pairs row by row. For a tree with itself each pair comes once.
    """
    slack = reach + 1e-6  # distances near 0 carry rounding
    same = a is b
    stack = [(0, 0)]
    own = lambda t, n: np.arange(t.first[n], t.last[n]) if t.first[n] < t.last[n] else np.array([n])
    while stack:
        m, n = stack.pop()
        if a.first[m] == a.last[m] and b.first[n] == b.last[n]:
            yield a.rows[a.start[m] : a.end[m]], b.rows[b.start[n] : b.end[n]], False
            continue
        left, right = own(a, m), own(b, n)
        alone_a, alone_b = (a.end - a.start)[left] == 1, (b.end - b.start)[right] == 1
        half = same and m == n
        for p, q, once in ((left[alone_a], right[alone_b], half), (left[~alone_a], right[~alone_b], half), (left[~alone_a], right[alone_b], False), (left[alone_a][: 0 if half else None], right[~alone_b], False)):
            alone = len(p) and len(q) and a.end[p[0]] - a.start[p[0]] == 1 and b.end[q[0]] - b.start[q[0]] == 1
            far = b.vectors[b.center[q]].T
            for lo in range(0, len(p) if len(q) else 0, INSERT_ROWS):
                some = p[lo : lo + INSERT_ROWS]
                dots = a.vectors[a.center[some]] @ far
                a.counted += dots.size
                # single vectors link by their cosine; else by the cosine at the distance that the radii leave
                i, k = np.nonzero(dots >= (cosine if alone else 1 - 1e-12 - np.minimum(slack + a.radius[some][:, None] + b.radius[q], 2.0) ** 2 / 2))
                if once:
                    keep = some[i] < q[k] if alone else some[i] <= q[k]
                    i, k = i[keep], k[keep]
                if alone:
                    yield a.center[some[i]], b.center[q[k]], True
                else:
                    stack += zip(some[i].tolist(), q[k].tolist(), strict=True)


def block_links(a: CoverTree, b: CoverTree, ca: np.ndarray, cb: np.ndarray, ia: np.ndarray, ib: np.ndarray, cosine: float):  # noqa: ANN201
    """(links of each row of a, of b, edges (node, node)) of two blocks with counts and ids; a may be b."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    x, y, same = a.vectors, b.vectors, a is b
    deg_a, deg_b, edges = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), set()
    for p, q, pairs in dual_traversal(a, b, reach, cosine):
        if pairs:
            np.add.at(deg_a, p, cb[q])
            np.add.at(deg_b, q, ca[p])
            edges.update(zip(ia[p].tolist(), ib[q].tolist(), strict=True))
            continue
        twice = same and p[0] == q[0]  # one leaf with itself
        for at in range(0, len(p), 1024):
            r = p[at : at + 1024]
            hit = x[r] @ y[q].T >= cosine
            a.counted += hit.size
            if same:
                hit &= ia[r][:, None] != ib[q]
            if not hit.any():
                continue
            deg_a[r] += hit @ cb[q]
            if not twice:
                deg_b[q] += ca[r] @ hit
            u, v = hit.any(axis=1), hit.any(axis=0)
            hit, us, vs = hit[np.ix_(u, v)], ia[r][u], ib[q][v]
            lab_u, lab_v = us.copy(), vs.copy()
            big = np.iinfo(np.int64).max
            while True:  # components of this small bipartite graph
                new_v = np.minimum(lab_v, np.where(hit, lab_u[:, None], big).min(axis=0))
                new_u = np.minimum(lab_u, np.where(hit, new_v, big).min(axis=1))
                if (new_u == lab_u).all() and (new_v == lab_v).all():
                    break
                lab_u, lab_v = new_u, new_v
            edges.update(zip(us.tolist(), lab_u.tolist(), strict=True))
            edges.update(zip(vs.tolist(), lab_v.tolist(), strict=True))
    return deg_a, deg_b, [e for e in edges if e[0] != e[1]]


def near_vectors(vectors: DataFrame, cosine: float, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: id, n_links, component_id (least id), kept."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    base = vectors.select(F.monotonically_increasing_id().alias("nid"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    base = base.withColumn("ok", F.coalesce(F.col("label").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False)))
    base = shared_table(base, "vectors")
    good = base.where("ok")
    reps = shared_table(good.groupBy("label", "v").agg(F.min(F.struct(F.col("id").isNull(), "id", "nid")).alias("m"), F.count(F.lit(1)).alias("c")).select("label", "v", F.size("v").alias("dim"), F.col("m.nid").alias("rep"), "c"), "reps")

    # pivots: of each label the vectors whose hash lies below a threshold, in proportion to its rows
    counts = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = min(1.0 / block_rows, MAX_PIVOTS / max(total, 1))
    large = counts.select("label", "dim")
    drawn = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 40)) < int(share * (1 << 40))).join(large, ["label", "dim"], "left_semi")
    picked: dict[tuple, list] = {}
    for r in drawn.select("label", "dim", "v").collect():  # MAX_PIVOTS in the mean, at most
        picked.setdefault((r.label, r.dim), []).append(r.v)
    tops: dict[tuple, np.ndarray] = {}
    for key, rows in picked.items():
        p = np.array(rows, np.float64)
        p /= np.abs(p).max(axis=1, keepdims=True)
        tops[key] = p / np.linalg.norm(p, axis=1, keepdims=True)

    def unit(v: np.ndarray) -> np.ndarray:
        v = v / np.abs(v).max(axis=1, keepdims=True)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    label_type = reps.schema["label"].dataType.simpleString()

    def assign(batches):  # noqa: ANN001, ANN202
        for b in batches:
            labels, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
            cell, dist = np.zeros(len(rows), np.int64), np.full(len(rows), 2.0)
            groups: dict[tuple, list[int]] = {}
            for i, (lab, v) in enumerate(zip(labels, rows, strict=True)):
                groups.setdefault((lab, len(v)), []).append(i)
            out = [None] * len(rows)
            for k, at in groups.items():
                v = unit(np.array([rows[i] for i in at], np.float64))
                if k in tops:
                    d = distances(v, tops[k])
                    cell[at], dist[at] = d.argmin(axis=1), d.min(axis=1)
                for i, x in zip(at, v, strict=True):
                    out[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), pa.array(cell), pa.array(dist), pa.array(out, pa.binary())], names=["label", "dim", "rep", "c", "cell", "dist", "u"])

    dealt = shared_table(reps.select("label", "v", "dim", "rep", "c").mapInArrow(assign, f"label {label_type}, dim int, rep long, c long, cell long, dist double, u binary"), "dealt")
    cells = dealt.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"))
    cells = cells.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    centre = {(str(k[0]), k[1]): p for k, p in tops.items()}

    @F.pandas_udf("boolean")
    def apart(label, dim, c1, c2, reach):  # noqa: ANN001, ANN202
        """Whether two cells are too far from each other for a link."""
        import pandas as pd

        out = []
        for lab, d, i, j, r in zip(label, dim, c1, c2, reach, strict=True):
            p = centre.get((lab, d))
            out.append(p is not None and i != j and float(distances(p[[i]], p[[j]])[0, 0]) > r + 1e-6)
        return pd.Series(out, dtype=bool)

    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    one, two = (cells.select("label", "dim", F.col("cell").alias(f"c{s}"), F.col("radius").alias(f"r{s}"), F.col("blocks").alias(f"n{s}")) for s in "12")
    pairs = one.join(two, ["label", "dim"]).where("c1 <= c2").where(~apart(F.col("label").cast("string"), "dim", "c1", "c2", F.col("r1") + F.col("r2") + reach))  # of cells, not of rows
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = pairs.withColumn("s1", upto("n1")).withColumn("s2", upto("n2")).where("c1 < c2 or s1 <= s2").select("label", "dim", "c1", "s1", "c2", "s2")
    pairs = shared_table(pairs, "blockpairs")  # of blocks
    placed = dealt.join(broadcast_if_small(cells.select("label", "dim", "cell", "blocks")), ["label", "dim", "cell"])
    placed = placed.withColumn("s", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        u = np.stack([np.frombuffer(x, np.float64) for x in t.column("u").to_pylist()])
        out = io.BytesIO()
        np.savez(out, u=u, rep=t.column("rep").to_numpy(), c=t.column("c").to_numpy(), **CoverTree(u).pack())
        return pa.table([*(t.column(k).slice(0, 1) for k in ("label", "dim", "cell", "s")), pa.array([out.getvalue()], pa.binary())], names=["label", "dim", "cell", "s", "data"])

    blocks = placed.groupBy("label", "dim", "cell", "s").applyInArrow(pack, f"label {label_type}, dim int, cell long, s int, data binary")
    blocks = shared_table(blocks, "blocks")
    left = blocks.select("label", "dim", F.col("cell").alias("c1"), F.col("s").alias("s1"), "data").join(pairs, ["label", "dim", "c1", "s1"])
    right = blocks.select("label", "dim", F.col("cell").alias("c2"), F.col("s").alias("s2"), "data").join(pairs.where("c1 <> c2 or s1 <> s2"), ["label", "dim", "c2", "s2"])
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    key = ["label", "dim", "c1", "s1", "c2", "s2"]

    def opened(t: pa.Table):  # noqa: ANN202
        with np.load(io.BytesIO(t.column("data")[0].as_py()), allow_pickle=False) as f:
            got = {k: f[k] for k in f.files}
        return CoverTree.unpack(got, got["u"]), got["c"], got["rep"]

    def compare(t: pa.Table, o: pa.Table) -> pa.Table:
        a, ca, ia = opened(t)
        b, cb, ib = opened(o) if o.num_rows else (a, ca, ia)
        da, db, edges = block_links(a, b, ca, cb, ia, ib, cosine)
        ids, deg = (np.concatenate([ia, ib]), np.concatenate([da, db])) if o.num_rows else (ia, da + db)
        ids, deg = ids[deg > 0], deg[deg > 0]
        ends = np.array(edges, np.int64).reshape(-1, 2)
        n = np.concatenate([deg, np.zeros(len(ends), np.int64)])
        return pa.table({"a": pa.array(np.concatenate([ids, ends[:, 0]])), "b": pa.array(np.concatenate([ids, ends[:, 1]])), "n": pa.array(n)})

    found = shared_table(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "a long, b long, n long"), "links")
    for gone in (dealt, pairs, blocks):
        drop_shared(gone)
    degrees = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("deg"))
    roots = connected_components(found.where("a <> b"))
    info = reps.select("label", "v", "rep", "c").join(degrees, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    info = shared_table(info.where("c > 1 or root is not null").select("label", "v", F.coalesce("root", "rep").alias("root"), (F.coalesce("deg", F.lit(0)) + F.col("c") - 1).alias("n_links")), "info")
    rows = shared_table(good.select("nid", "id", "label", "v").join(info, ["label", "v"]).select("nid", "id", "root", "n_links"), "linked")
    for gone in (reps, found, info):
        drop_shared(gone)
    least = rows.groupBy("root").agg(F.min("id").alias("component_id"))
    done = rows.join(broadcast_if_small(least), "root").select("nid", "n_links", "component_id")
    out = base.select("nid", "id").join(done, "nid", "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").cast(id_type).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
