"""Operator 12: alignment of the tokens of two tokenizers by lockstep merging.

Both tokenizers see a blank and the text; their tokens are byte ranges of it.
Byte offsets where tokens of both end cut them into groups. A blank after a
character that is no white space starts a token in both vocabularies (tested when
they are read; else a text is one unit), so every document of a batch is a row of
units between such places, and no group reaches across them. Each distinct unit is
encoded and aligned once and kept; documents are put together from their units in
columns.

The units of a batch that are not known yet enter as lanes, one behind the other.
A state vector in numpy has, for every lane, a pointer into its A tokens and one
into its B tokens. Each step compares the ends that all pointers name: equal ends
are a cut, which emits a group (its links are all its A-B pairs) and moves both
pointers, else the pointer with the lesser end moves. Lanes that are done leave the
vector.

Spark counts, for each pair of ids, the documents that hold it linked. Pairs in
more than 1/HOT_PAIRS of all (document, pair) rows are fewer than HOT_PAIRS and are
broadcast, the others meet their documents in a join where no key is hot.

Cases: texts that are null or empty, or whose joined A or B bytes are not a blank
and the text, have no tokens and zeros; repeated and null ids are rows of their
own and count as documents of their own; an empty table gives no rows; extra
columns are ignored; ids of special tokens never occur, as their strings are plain
text. Memory grows with the longest run without a blank, with a text and with its
distinct linked pairs.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscan.llm.bpe import batches_of, byte_letters, merged
from traitscan.llm.common import shared_table, small_batches

#: Units whose alignment a worker keeps, and the bytes of it.
CACHE_UNITS, CACHE_BYTES = 200_000, 1 << 26
#: Units of a lane, which are encoded as one text.
LANE_UNITS = 64
#: Units that are encoded and aligned at once.
LEARN_UNITS = 8192
#: Characters of the texts that are aligned at once.
BATCH_CHARS = 1 << 20
#: Pairs that are broadcast, at most.
HOT_PAIRS = 200_000
#: Links of a group from which on its ids are counted before they are paired.
LARGE_GROUP = 4096

_UNITS = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s ")
_BLANK = re.compile(r"\S ")


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places in runs of the given starts and sizes, run after run."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


class Known:
    """Aligned units, a row each: counts, the digest's text behind which a sign follows, linked pairs and how often."""

    def __init__(self, names: list[str], counts: np.ndarray, bad: np.ndarray, text_at: np.ndarray, text: np.ndarray, pairs_at: np.ndarray, pairs: np.ndarray, times: np.ndarray, uses: np.ndarray):
        self.names, self.counts, self.bad, self.uses = names, counts, bad, uses
        self.text_at, self.text, self.pairs_at, self.pairs, self.times = text_at, text, pairs_at, pairs, times
        self.rows = dict(zip(names, range(len(names)), strict=True))

    @staticmethod
    def none() -> Known:
        zero = np.zeros(1, np.int64)
        return Known([], np.zeros((0, 4), np.int64), np.zeros(0, bool), zero, np.zeros(0, np.uint8), zero, zero[:0], zero[:0], zero[:0])

    def nbytes(self) -> int:
        return self.text.nbytes + self.pairs.nbytes + self.times.nbytes

    def only(self, rows: np.ndarray) -> Known:
        """Some rows; their uses count half from now on."""
        sizes = self.pairs_at[rows + 1] - self.pairs_at[rows]
        places = _places(self.pairs_at[rows], sizes)
        return Known([self.names[i] for i in rows.tolist()], self.counts[rows], self.bad[rows], *self.texts(rows), _offsets(sizes), self.pairs[places], self.times[places], self.uses[rows] // 2)

    def texts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of rows, one behind the other, and where they begin and end."""
        if not len(rows):
            return np.zeros(1, np.int64), np.zeros(0, np.uint8)
        every = pa.Array.from_buffers(pa.large_binary(), len(self.names), [None, pa.py_buffer(self.text_at), pa.py_buffer(self.text)])
        _, at, data = every.take(pa.array(rows)).buffers()
        at = np.frombuffer(at, np.int64, len(rows) + 1)
        return at, np.frombuffer(data or b"", np.uint8)[: at[-1]]

    def add(self, more: list[Known]) -> None:
        every = [self, *more]
        for at, c in (("text_at", "text"), ("pairs_at", "pairs")):
            before = _offsets(np.array([len(getattr(x, c)) for x in every]))
            setattr(self, at, np.concatenate([self.text_at[:1], *(getattr(x, at)[1:] + n for x, n in zip(every, before[:-1], strict=True))]))
        for c in ("counts", "bad", "text", "pairs", "times", "uses"):
            setattr(self, c, np.concatenate([getattr(x, c) for x in every]))
        for x in more:
            self.rows.update(zip(x.names, range(len(self.names), len(self.names) + len(x.names)), strict=True))
            self.names += x.names


class Pair:
    """The two tokenizers, with the units known."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=path_b)
        byte = {c: i for i, c in enumerate(byte_letters())}
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        if max(len(self.len_a), len(self.len_b)) >= 10**7:
            raise ValueError("vocabularies of 10,000,000 ids or more")
        lead = self.b.encode("\n")
        self.lead = len(lead)
        # a unit is encoded behind a line end, which must be a token of its own and part the text for certain
        parted = not any("\n" in p for p in pieces) and self.bytes_b[lead[-1]] == b"\n" and not any(p[i] != "▁" and p[i + 1] == "▁" for p in pieces for i in range(len(p) - 1))
        inside = any(_BLANK.search(t.decode("utf-8", "replace")) for t in self.bytes_a)
        self.parted = parted and not inside
        self.known = Known.none()

    def units(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Units without the blank before each, the text of each, and the texts in this order.

        The text behind a blank is parted where a token of both must begin.
        """
        odd = [i for i, t in enumerate(texts) if t and (not self.parted or _ODD.search(" " + t))]
        rest = set(odd)
        plain = [i for i, t in enumerate(texts) if t and i not in rest]
        split = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        parts = [[u[1:] for u in _UNITS.split(" " + texts[i])] if self.parted else [texts[i]] for i in odd]
        flat = pa.concat_arrays([split.flatten(), pa.array(itertools.chain.from_iterable(parts), pa.large_string())])
        order = np.array(plain + odd, np.int64)
        sizes = np.concatenate([np.diff(split.offsets.to_numpy()), np.array([len(p) for p in parts], np.int64)])
        return flat, np.repeat(order, sizes), order

    def _encode(self, lanes: list[list[str]]) -> tuple[list[list[int]], list[list[int]]]:
        texts = [" " + " ".join(lane) for lane in lanes]
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        if not self.parted:
            return a, self.b.encode([t[1:] for t in texts], num_threads=1)
        return a, [ids[self.lead :] for ids in self.b.encode(["\n" + t for t in texts], num_threads=1)]

    def _same(self, a: list[list[int]], b: list[list[int]], lanes: list[list[str]]) -> list[bool]:
        """Whether the bytes of both sides are those of each lane."""
        joined = lambda known, ids: b"".join(map(known.__getitem__, ids))
        return [joined(self.bytes_a, x) == joined(self.bytes_b, y) == (" " + " ".join(lane)).encode() for x, y, lane in zip(a, b, lanes, strict=True)]

    def _aligned(self, names: list[str]) -> Iterator[Known]:
        """Rows of new units."""
        plain = [u for u in names if self.parted and u.isascii() and u and not u[-1].isspace()]
        rest = set(names).difference(plain)
        lanes = [plain[k : k + LANE_UNITS] for k in range(0, len(plain), LANE_UNITS)] + [[u] for u in names if u in rest]
        while lanes:
            a, b = self._encode(lanes)
            same = self._same(a, b, lanes)
            yield align_lanes(self, *([x for x, s in zip(xs, same, strict=True) if s] for xs in (lanes, a, b)))
            other = [lane for lane, s in zip(lanes, same, strict=True) if not s]
            bad = [u for lane in other for u in lane if len(lane) == 1]
            zeros = np.zeros(len(bad), np.int64)
            yield Known(bad, np.zeros((len(bad), 4), np.int64), np.ones(len(bad), bool), _offsets(zeros), np.zeros(0, np.uint8), _offsets(zeros), zeros[:0], zeros[:0], zeros)
            lanes = [[u] for lane in other for u in lane if len(lane) > 1]  # which of them differs

    def look_up(self, names: list[str], uses: np.ndarray) -> np.ndarray:
        """The rows of distinct units, known or learned."""
        found = list(map(self.known.rows.get, names))
        fresh = [u for u, i in zip(names, found, strict=True) if i is None]
        if fresh:
            full = self.known.nbytes() > CACHE_BYTES
            if full or len(self.known.names) + len(fresh) > CACHE_UNITS:
                keep = np.zeros(len(self.known.names), bool)
                if not full:  # the half with the most uses
                    keep[np.argsort(-self.known.uses, kind="stable")[: CACHE_UNITS // 2]] = True
                keep[[i for i in found if i is not None]] = True
                self.known = self.known.only(np.flatnonzero(keep))
            self.known.add([more for k in range(0, len(fresh), LEARN_UNITS) for more in self._aligned(fresh[k : k + LEARN_UNITS])])
            found = list(map(self.known.rows.__getitem__, names))
        rows = np.array(found, np.int64)
        self.known.uses[rows] += uses
        return rows


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, last_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cuts of all lanes, as the numbers of A and B tokens before each, in the order of the text.

    end_a, end_b: byte offsets where tokens end, ascending over all lanes;
    first_a, last_a, first_b: each lane's first A token, the one behind its last, and
    its first B token. Both sides of a lane end at one offset.
    """
    i, j, last = first_a.copy(), first_b.copy(), last_a
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    live = i < last
    i, j, last = i[live], j[live], last[live]
    while len(i):
        x, y = end_a[i], end_b[j]
        cut = x == y
        cut_a[i[cut]] = True
        cut_b[j[cut]] = True
        i = i + (x <= y)
        j = j + (y <= x)
        live = i < last
        if not live.all():
            i, j, last = i[live], j[live], last[live]
    return np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1


def _digits(ids: np.ndarray) -> np.ndarray:
    """Decimal digits of each id, behind zero bytes, with a last column for a sign."""
    width = len(str(int(ids.max()))) if len(ids) else 1
    out = np.zeros((len(ids), width + 1), np.uint8)
    left = ids.astype(np.int64)
    for k in range(width - 1, -1, -1):
        out[:, k] = np.where((left > 0) | (k == width - 1), left % 10 + 48, 0)
        left //= 10
    return out


def link_pairs(ids_a: np.ndarray, ids_b: np.ndarray, from_a: np.ndarray, to_a: np.ndarray, from_b: np.ndarray, to_b: np.ndarray, doc: np.ndarray, size_a: int, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, A id, B id, links) of the distinct linked pairs of each document, in that order."""
    n_a, n_b = to_a - from_a, to_b - from_b
    links = n_a * n_b
    few = links <= LARGE_GROUP
    rep = links[few]
    group = np.repeat(np.flatnonzero(few), rep)
    place = np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)
    a = ids_a[from_a[group] + place // n_b[group]].astype(np.int64)
    b = ids_b[from_b[group] + place % n_b[group]].astype(np.int64)
    keys, counts = np.unique((doc[group] * size_a + a) * size_b + b, return_counts=True)
    for g in np.flatnonzero(~few):  # count the ids of a large group first
        xs, cx = np.unique(ids_a[from_a[g] : to_a[g]].astype(np.int64), return_counts=True)
        ys, cy = np.unique(ids_b[from_b[g] : to_b[g]].astype(np.int64), return_counts=True)
        keys = np.concatenate([keys, (((doc[g] * size_a + xs) * size_b)[:, None] + ys).ravel()])
        counts = np.concatenate([counts, (cx[:, None] * cy).ravel()])
    if not few.all():
        keys, where = np.unique(keys, return_inverse=True)
        counts = np.bincount(where, weights=counts, minlength=len(keys)).astype(np.int64)
    return keys // (size_a * size_b), keys // size_b % size_a, keys % size_b, counts


def align_lanes(pair: Pair, lanes: list[list[str]], a: list[list[int]], b: list[list[int]]) -> Known:
    """The units of lanes with their ids in both vocabularies, aligned in lockstep."""
    names = list(itertools.chain.from_iterable(lanes))
    ids_a, ids_b = (np.fromiter(itertools.chain.from_iterable(x), np.int64) for x in (a, b))
    lane_a, lane_b = (_offsets(np.array([len(x) for x in side], np.int64)) for side in (a, b))
    end_a, end_b = np.cumsum(pair.len_a[ids_a]), np.cumsum(pair.len_b[ids_b])
    to_a, to_b = lockstep(end_a, end_b, lane_a[:-1], lane_a[1:], lane_b[:-1])
    zero = np.zeros(1, np.int64)
    from_a, from_b = (np.concatenate([zero, x[:-1]])[: len(x)] for x in (to_a, to_b))
    unit_end = np.cumsum(np.array([(len(u) if u.isascii() else len(u.encode())) + 1 for u in names], np.int64))
    unit = np.searchsorted(unit_end, end_a[to_a - 1])
    n_a, n_b = to_a - from_a, to_b - from_b

    # a1,a2|b1;a3|b2,b3; where every id has the sign behind it, A ids of a group before its B ids
    digits = np.zeros((len(ids_a) + len(ids_b), 8), np.uint8)
    at_a = np.arange(len(ids_a)) + np.repeat(from_b, n_a)
    at_b = np.arange(len(ids_b)) + np.repeat(to_a, n_b)
    for at, ids, ends, sign in ((at_a, ids_a, to_a, b"|"), (at_b, ids_b, to_b, b";")):
        d = _digits(ids)
        d[:, -1] = ord(",")
        d[ends - 1, -1] = sign[0]
        digits[at, 8 - d.shape[1] :] = d
    shown = digits != 0
    last = np.searchsorted(unit, np.arange(len(names)), "right") - 1  # the last group of each unit
    text_at = np.concatenate([zero, np.cumsum(shown.sum(axis=1))[(to_a + to_b)[last] - 1]]) if names else zero
    at, n = _offsets(n_a * n_b), np.diff(last, prepend=-1)
    per_unit = lambda cum: np.diff(cum[last], prepend=0)
    counts = np.stack([per_unit(to_a), per_unit(to_b), n, per_unit(at[1:])], axis=1)
    who, x, y, times = link_pairs(ids_a, ids_b, from_a, to_a, from_b, to_b, unit, len(pair.len_a), len(pair.len_b))
    none = np.zeros(len(names), np.int64)
    return Known(names, counts, none > 0, text_at, digits[shown], np.searchsorted(who, np.arange(len(names) + 1)), x * len(pair.len_b) + y, times, none)


def align_batch(pair: Pair, texts: list[str | None]) -> dict[str, np.ndarray | list]:
    """Columns of the aligned table for a batch of texts."""
    flat, doc, order = pair.units(texts)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    rows = pair.look_up(names, np.bincount(codes, minlength=len(names)))[codes]
    known = pair.known
    bad = known.bad[rows]
    if bad.any():  # a document with a unit whose bytes differ has no tokens
        good = np.ones(len(texts), bool)
        good[doc[bad]] = False
        rows, doc = rows[good[doc]], doc[good[doc]]
    size = np.bincount(doc, minlength=len(texts))
    to = np.cumsum(size[order])
    ends = np.zeros(len(texts), np.int64)
    ends[order] = to
    starts = ends - size
    at, data = known.texts(rows)
    hashes = [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[starts].tolist(), at[ends].tolist(), strict=True)]

    held, often = np.unique(doc * len(known.names) + rows, return_counts=True)  # distinct units of each document
    row, who = held % max(len(known.names), 1), held // max(len(known.names), 1)
    sums = np.zeros((len(row) + 1, 4), np.int64)
    np.cumsum(known.counts[row] * often[:, None], axis=0, out=sums[1:])
    counts = np.diff(sums[np.searchsorted(who, np.arange(len(texts) + 1))], axis=0)
    n = known.pairs_at[row + 1] - known.pairs_at[row]
    places = _places(known.pairs_at[row], n)
    size_b = len(pair.len_b)
    span = len(pair.len_a) * size_b
    keys = known.pairs[places] + np.repeat(who * span, n)
    by = np.argsort(keys)
    keys = keys[by]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    k = np.add.reduceat((known.times[places] * np.repeat(often, n))[by], first) if len(first) else first
    keys = keys[first]
    out = dict(zip(("n_a", "n_b", "n_groups", "n_links"), counts.T, strict=True))
    return out | {"groups_sha256": hashes, "pairs": np.searchsorted(keys, np.arange(len(texts) + 1) * span), "a": keys % span // size_b, "b": keys % size_b, "k": k}


_MADE: dict[tuple[str, str], Pair] = {}
ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, k array<long>"


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts, its groups' digest, and its distinct linked pairs (a, b) with their links k."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _MADE:
            _MADE[path_a, path_b] = Pair(path_a, path_b)
        pair = _MADE[path_a, path_b]
        for batch in merged(batches, BATCH_CHARS):
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_of(texts, BATCH_CHARS):
                x = align_batch(pair, texts[lo:hi])
                lists = [pa.ListArray.from_arrays(pa.array(x["pairs"], pa.int32()), pa.array(x[c], t)) for c, t in (("a", pa.int32()), ("b", pa.int32()), ("k", pa.int64()))]
                counts = [pa.array(x[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *counts, pa.array(x["groups_sha256"], pa.string()), *lists], names=[id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "k"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, {ALIGNED}")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, docs, best) of rows (a, b), one for each document that holds a pair; best: the most documents of its a."""
    counts = shared_table(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs")), "paircounts")
    most = counts.groupBy("a").agg(F.max("docs").alias("_most"))  # a row for each id of the vocabulary at most
    return counts.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("_most")).alias("best"))


def cross_token_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = aligned_documents(docs, path_a, path_b, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    found = shared_table(found, "aligned")
    rows = found.select("_row", F.explode(F.arrays_zip("a", "b", "k")).alias("p")).select("_row", "p.a", "p.b", "p.k")
    counts = shared_table(pair_counts(rows), "bestpairs")
    total = counts.agg(F.sum("docs")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("docs") > total / hot_pairs))  # the docs add up to total, so these are fewer than hot_pairs
    cold = counts.where(F.col("docs") <= total / hot_pairs)
    sums = [F.sum(F.col("k") * F.col("docs")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best")]
    some = rows.join(hot, ["a", "b"]).groupBy("_row").agg(*sums)
    rest = rows.join(hot, ["a", "b"], "left_anti").join(cold, ["a", "b"]).groupBy("_row").agg(*sums)
    both = some.union(rest).groupBy("_row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select(id_col, "_row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(both, "_row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
