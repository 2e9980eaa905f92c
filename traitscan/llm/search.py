"""Operator 1: exact top-k BM25 search with a sharded inverted index and block-max pruning.

A task cuts its rows into shards of bounded rows and postings, so nothing is
shuffled and null or repeated ids cannot fill one shard; a shard is one row:
sorted term hashes and their postings. Its documents lie in the order of their
most frequent word and length, so that the 16 of a block are alike. Document
frequencies, the document count and the mean length are global, so scores of
different shards compare exactly.

Pruning is WAND's test, made for all documents of a shard at once. A query's
terms are taken from rare to common. Postings of sparse terms are added up
first; common terms have only the largest term-frequency part of each block
looked up. A document whose sum so far and block maxima together stay below the
k-th score is left out, and postings of common terms are read for the others
alone, with the test repeated as terms are used up. The k-th score starts from the
documents that are best by their sparse terms, and in all shards but the first
few from the k-th score that those found. Which terms are rare or common is told
by all the corpus, so scores are sums in one order of terms, and equal texts score
equally in every shard.

Cases: a null or empty text is indexed with length 0 and never found; a query
without a known term has no results; ties are broken by the smaller id, null ids
last; repeated rows are results of their own; queries with null or repeated ids
are queries of their own; ids may be of any type that has an order; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitscan.llm.common import broadcast_if_small, drop_shared, shared_table, small_batches
from traitscan.llm.minhash import word_hashes

K1, B = 1.2, 0.75
#: Rows and postings of a shard, at most (a text of more postings is a shard of its own).
SHARD_ROWS, SHARD_POSTINGS = 8192, 6_000_000
#: Rows of a task that is kept for the sake of parallel work.
LEAST_ROWS = 1024
BLOCK = 16
#: A term is common if more than this part of all documents hold it, else rare.
COMMON_PART = 1 / 8
#: Queries that are sent to the shards at once, and their terms in all: some 25 MB.
QUERY_BLOCK, QUERY_TERMS = 4096, 2_000_000
#: One shard in so many is searched first, to give the others a k-th score.
FIRST_PART = 8
#: Common terms that are added between two tests of what can still reach the k-th score.
STEP = 12
SLACK = 1e-9  # bounds and scores are rounded in different orders


def term_hashes(text: str | None) -> np.ndarray:
    """A 63-bit hash of every word; A-Z lowered, split at ASCII white space."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    if not raw:
        return np.zeros(0, np.int64)
    return (word_hashes(np.frombuffer(raw, np.uint8))[0] >> np.uint64(1)).astype(np.int64)


def tf_part(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-9)))


def inverted(ids: pa.Array, terms: list[np.ndarray], freqs: list[np.ndarray], lengths: list[int]) -> list[pa.Array]:
    """One shard: ids, lengths, names, first, doc, tf and the number of words."""
    top = np.array([t[np.argmax(f)] if len(t) else -1 for t, f in zip(terms, freqs, strict=True)], np.int64)
    size = np.array(lengths, np.int64)
    place = np.lexsort((size, top))
    doc = np.repeat(np.arange(len(place), dtype=np.int32), [len(terms[i]) for i in place])
    term = np.concatenate([terms[i] for i in place])
    tf = np.concatenate([freqs[i] for i in place])
    order = np.argsort(term, kind="stable")
    term, doc, tf = term[order], doc[order], tf[order]
    names, first = np.unique(term, return_index=True)
    pack = lambda a, kind: pa.array([np.asarray(a).astype(kind).tobytes()], pa.binary())
    taken = ids.take(pa.array(place))
    lists = pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), taken)
    kind = "<u4" if len(place) > 65536 or (len(tf) and tf.max() > 65535) else "<u2"
    return [lists, pack(size[place], "<i8"), pack(names, "<i8"), pack(np.append(first, len(term)), "<i4"), pack(doc, kind), pack(tf, kind), pa.array([kind]), pa.array([int(size.sum())], pa.int64())]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int, float]:
    """(the index, one row per shard; the number of documents; their mean length)."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    n = base.count()
    names = ["ids", "lengths", "names", "first", "doc", "tf", "kind", "total"]

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, freqs, lengths, held = [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(inverted(pa.concat_arrays(ids), terms, freqs, lengths), names=names)

        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):
                h = term_hashes(text)
                t, c = np.unique(h, return_counts=True)
                if terms and (len(terms) >= shard_rows or held + len(t) > SHARD_POSTINGS):
                    yield shard()
                    ids, terms, freqs, lengths, held = [], [], [], [], 0
                ids.append(b.column(0).slice(i, 1))
                terms.append(t)
                freqs.append(c.astype("<u4"))
                lengths.append(len(h))
                held += len(t)
        if terms:
            yield shard()

    schema = f"ids array<{id_type}>, lengths binary, names binary, first binary, doc binary, tf binary, kind string, total long"
    # tasks of less than a shard are joined, without a shuffle, as long as none lies idle for it
    tasks = max(-(-n // shard_rows), min(docs.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))
    shards = base.coalesce(max(1, tasks)).mapInArrow(invert, schema)
    index = shared_table(shards.withColumn("shard", F.monotonically_increasing_id()), "index")
    return index, n, (index.agg(F.sum("total")).first()[0] or 0) / max(n, 1)


class Shard:
    """One shard in memory; the parts of common terms are rows over all documents, with their block maxima."""

    def __init__(self, ids: pa.Array, row: dict, mean: float, common: np.ndarray):
        get = lambda k, kind: np.frombuffer(row[k], kind)
        self.ids, self.n = ids, len(ids)
        self.rank = np.empty(self.n, np.int64)  # place in the order of ids, null last
        self.rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(self.n)
        self.names, self.first = get("names", "<i8"), get("first", "<i4")
        self.doc = get("doc", row["kind"]).astype(np.int64)
        self.part = tf_part(get("tf", row["kind"]).astype(np.float64), get("lengths", "<i8")[self.doc], mean)
        blocks = -(-self.n // BLOCK)
        self.row_of = np.full(len(self.names), -1, np.int32)
        at = self.find(common)
        at = at[at >= 0]
        self.row_of[at] = np.arange(len(at))
        self.rows = np.zeros((len(at), blocks * BLOCK))
        for r, t in enumerate(at.tolist()):
            s = slice(self.first[t], self.first[t + 1])
            self.rows[r, self.doc[s]] = self.part[s]
        self.maxima = self.rows.reshape(len(at), blocks, BLOCK).max(axis=2) if blocks else np.zeros((len(at), 0))
        self.read = 0  # postings read so far

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Places of sorted terms in this shard, -1 if absent."""
        if not len(self.names):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.names, terms), len(self.names) - 1)
        return np.where(self.names[at] == terms, at, -1)

    def _add(self, score: np.ndarray, docs: np.ndarray, rows: list[int], weights: list[float]) -> np.ndarray:
        for r, w in zip(rows, weights, strict=True):
            score = score + w * self.rows[r].take(docs)
        self.read += len(rows) * len(docs)
        return score

    def top(self, at: np.ndarray, weights: np.ndarray, rare: int, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best documents, ties to the smaller id.

        at, weights: the places of the query's terms and their weights, from rare
        to common, the first `rare` of them rare. Documents that
        score below `least` may be left out.
        """
        few, common = at[:rare], at[rare:]
        w_few, weights = weights[:rare][few >= 0], weights[rare:][common >= 0]
        few, rows = few[few >= 0], self.row_of[common[common >= 0]]
        score = np.zeros(self.n)
        if len(few):
            spans = list(map(slice, self.first[few].tolist(), self.first[few + 1].tolist()))
            value = np.concatenate([self.part[s] for s in spans]) * np.repeat(w_few, self.first[few + 1] - self.first[few])
            self.read += len(value)
            score = np.bincount(np.concatenate([self.doc[s] for s in spans]), value, self.n)
        reach = score
        if len(rows):
            maxima = self.maxima[rows]
            reach = score + np.repeat(weights @ maxima, BLOCK)[: self.n]
        docs = np.flatnonzero((reach >= least * (1 - SLACK)) & (reach > 0))
        names, w = rows.tolist(), weights.tolist()
        if len(docs) > 8 * k:  # a k-th score, from the documents that look best
            best = docs[np.argpartition(-score[docs], 4 * k)[: 4 * k]]
            least = max(least, float(np.sort(self._add(score[best], best, names, w))[-k]))
            docs = docs[reach[docs] >= least * (1 - SLACK)]
        score = score[docs]
        for done in range(0, len(rows), STEP):
            score = self._add(score, docs, names[done : done + STEP], w[done : done + STEP])
            if done + STEP < len(rows):
                keep = score + (weights[done + STEP :] @ maxima[done + STEP :])[docs // BLOCK] >= least * (1 - SLACK)
                docs, score = docs[keep], score[keep]
        if len(docs) > k:
            keep = score >= np.partition(score, -k)[-k]
            docs, score = docs[keep], score[keep]
        best = np.lexsort((self.rank[docs], -score))[:k]
        best = best[score[best] > 0]
        return docs[best], score[best]


def bm25_search(index: DataFrame, n: int, queries: DataFrame, k: int = 10, query_id: str = "query_id", text_col: str = "text", mean: float | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) of each query's k best documents.

    queries: ids and whole texts; a term counts as often as the query holds it.
    """
    spark = index.sparkSession
    small_batches(spark)
    mean = (index.agg(F.sum("total")).first()[0] or 0) / max(n, 1) if mean is None else mean
    base = queries.select(F.monotonically_increasing_id().alias("q"), F.col(query_id).alias("query_id"), F.col(text_col).cast("string").alias("text"))
    q_type, id_type = base.schema["query_id"].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, t, c = [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                terms, counts = np.unique(term_hashes(text), return_counts=True)
                who += [i] * len(terms)
                t.append(terms)
                c.append(counts)
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            who = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(1).take(who), cat(t), cat(c)], names=["q", "query_id", "t", "c"])

    terms = shared_table(base.mapInArrow(parse, f"q long, query_id {q_type}, t long, c long"), "queryterms")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(names, "<i8")), pa.array(np.diff(np.frombuffer(first, "<i4")).astype(np.int64))], names=["t", "df"])

    small_batches(spark, 1)  # a row is a whole shard
    df = index.select("names", "first").mapInArrow(names, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
    weighted = terms.join(df, "t").withColumn("w", F.col("c") * F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    rare = F.sum((F.col("df") <= n * COMMON_PART).cast("int")).alias("rare")
    packed = weighted.groupBy("q").agg(F.first("query_id").alias("query_id"), F.sort_array(F.collect_list(F.struct("df", "t", "w"))).alias("x"), rare)
    packed = shared_table(packed.select("q", "query_id", "x.t", "x.w", "x.df", "rare", F.size("x").alias("m")), "queries")
    drop_shared(terms)
    often = packed.select(F.explode(F.arrays_zip("t", "df")).alias("e")).where(F.col("e.df") > n * COMMON_PART).select("e.t").distinct()
    common = np.sort(np.array([r.t for r in often.collect()], np.int64))  # at most the mean count of a document's words, over COMMON_PART
    sizes = packed.agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m")).first()
    blocks = max(1, math.ceil(sizes.n / QUERY_BLOCK), math.ceil((sizes.m or 0) / QUERY_TERMS))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = lambda hits: hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    wave = F.pmod(F.xxhash64("shard"), F.lit(FIRST_PART)) == 0
    found = None
    for block in range(blocks):
        some = packed.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).select("q", "t", "w", "rare").toArrow()  # about QUERY_BLOCK rows
        who, rares, weights = some.column("q").to_pylist(), some.column("rare").to_pylist(), [np.array(w) for w in some.column("w").to_pylist()]
        terms_of = [np.array(t, np.int64) for t in some.column("t").to_pylist()]
        every, which = np.unique(np.concatenate([*terms_of, np.zeros(0, np.int64)]), return_inverse=True)
        which = np.split(which.astype(np.int32), np.cumsum([len(t) for t in terms_of])[:-1]) if terms_of else []
        least: dict[int, float] = {}
        for shards in (wave, ~wave):
            sent = spark.sparkContext.broadcast((every, [(q, x, w, r, least.get(q, 0.0)) for q, x, w, r in zip(who, which, weights, rares, strict=True)]))

            def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                for b in batches:
                    for i, row in enumerate(b.drop_columns(["ids"]).to_pylist()):
                        shard = Shard(b.column("ids")[i].values, row, mean, common)
                        every, asked = sent.value
                        at = shard.find(every)
                        hits = [(q, *shard.top(at[x], w, rare, k, low)) for q, x, w, rare, low in asked]
                        q = np.repeat(np.array([h[0] for h in hits], np.int64), [len(h[1]) for h in hits])
                        rows, scores = (np.concatenate([h[j] for h in hits]) if hits else np.zeros(0, np.int64) for j in (1, 2))
                        yield pa.RecordBatch.from_arrays([pa.array(q), shard.ids.take(pa.array(rows, pa.int64())), pa.array(scores, pa.float64())], names=["q", "doc_id", "score"])

            part = shared_table(index.where(shards).select("ids", "lengths", "names", "first", "doc", "tf", "kind").mapInArrow(search, f"q long, doc_id {id_type}, score double"), "hits")
            least = dict(best(part).where(F.col("rank") == k).select("q", "score").collect()) if shards is wave else {}  # a number for each query of the block
            found = part if found is None else found.union(part)
            sent.destroy()
    small_batches(spark)
    named = best(found).join(broadcast_if_small(packed.select("q", "query_id")), "q")
    return named.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")
