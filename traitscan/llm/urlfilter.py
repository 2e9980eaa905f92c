"""Operator 5: URL rules and lists through a blocked Bloom filter and an exact join.

A listed entry is a canonical URL, host and path joined, with a kind: `prefix`
entries fit their host and all its subdomains where the path starts with the
entry's path, `exact` entries fit the pages with their canonical form (host without
a leading www. and the ports 80 and 443, path without slashes at its end; scheme,
query and fragment do not count), `site` entries fit their host and all its
subdomains at any path. The longest prefix wins, first by host, then by path; a
page that no prefix fits takes the verdict of its exact entry, else of the longest
site entry.

Keys are 64-bit hashes of a host suffix and a path prefix. Both are hashed
incrementally, so the hashes of all suffixes and prefixes of a URL cost one pass
over it. A page asks a blocked Bloom filter for its host suffixes and its exact
key, and for path prefixes (of listed lengths) only under suffixes that pass as
hosts of prefix entries. Possible hits go into a hash join with the list, which
compares the texts themselves, so a false hit or an equal hash changes nothing;
pages without one are done and are not shuffled.

The filter is built by Spark (one row per 256-bit block) and broadcast while the
list is below a checked size; the keys of a longer list's pages meet the filter's
blocks in a join instead.

Cases: a null URL or one without :// has an empty host and path and no rule; a
page that no entry fits is allowed; of entries that repeat a key, block wins;
repeated pages are judged one by one; a rule without a slash fits every path of
its host; a URL of any length costs time in proportion to its length, a host of
very many labels too; other columns travel along, those named host, path, rule or
verdict are replaced by the result's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitscan.llm.common import shared_table

WORDS = 8  # 32-bit words of a block
#: Listed keys up to which the filter is broadcast: 4 MB at 16 bits a key.
FILTER_KEYS = 2_000_000
BITS_PER_KEY = 16
#: Hosts whose keys a worker keeps, and prefix keys that are asked for at once.
KEPT_HOSTS, ASKED_AT_ONCE = 50_000, 1_000_000
_U = np.uint64
_ODD = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)  # fixed values: the multipliers of split-block Bloom filters


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """host: after the first ://, up to / ? # or the end, A-Z lowered; path: then up to ? # or the end."""
    url = F.col(url_col).cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", F.coalesce(low, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Prefix entries from (verdict, rule): a rule is host, a slash and the rest of its path."""
    rows = [(verdict, rule, *(rule if "/" in rule else rule + "/").split("/", 1)) for verdict, rule in rules]
    made = spark.createDataFrame([(v, r, h.lower(), "/" + p) for v, r, h, p in rows], "verdict string, rule string, host string, path string")
    return made.withColumn("kind", F.lit("prefix"))


def site_table(spark: SparkSession, hosts: list[str]) -> DataFrame:
    """Blocked sites: entries of kind `site`, without a rule."""
    made = spark.createDataFrame([(h.lower(),) for h in hosts], "host string")
    return made.select(F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("rule"), "host", F.lit("").alias("path"), F.lit("site").alias("kind"))


def canonical(host: F.Column, path: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path of a URL as exact entries compare them."""
    return F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", ""), F.regexp_replace(path, "/+$", "")


# Kinds of keys: hosts of prefix entries, prefix entries, exact entries, sites.
HOST, PREFIX, EXACT, SITE = 1, 2, 3, 4
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _BASE, np.uint64)]))
    return _POWERS[0][:n]


def prefix_hashes(text: str, backwards: bool = False) -> np.ndarray:
    """The hashes of all prefixes (suffixes, if backwards) of a text by their length, from 0."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    codes = codes[::-1] if backwards else codes
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + _U(1)) * _powers(len(codes)))])


def mixed(kind: int, host: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Keys of a kind from hashes of hosts and paths."""
    with np.errstate(over="ignore"):
        h = host * _U(0xBF58476D1CE4E5B9) + path * _U(0x94D049BB133111EB) + _U(kind * _BASE & (1 << 64) - 1)
        for shift in (30, 27):
            h = (h ^ h >> _U(shift)) * _U(0xD6E8FEB86659FD93)
    return h ^ h >> _U(31)


def host_suffixes(host: str) -> np.ndarray:
    """The hashes of the host and of all that follows one of its dots."""
    h = prefix_hashes(host, backwards=True)
    dots = np.flatnonzero(np.frombuffer(host.encode("utf-32-le", "surrogatepass"), "<u4")[::-1] == ord("."))
    return h[np.append(dots, len(host))]


def _whole(text: str, backwards: bool = False) -> np.ndarray:
    return prefix_hashes(text, backwards)[-1:]


def keyed(listed: DataFrame) -> DataFrame:
    """One row per entry and key: its hash h, the winning verdict and the rule; prefix entries have a host key too."""
    host, path = canonical(F.col("host"), F.col("path"))
    exact = F.col("kind") == "exact"
    one = listed.select("kind", F.when(exact, host).otherwise(F.col("host")).alias("host"), F.when(exact, path).otherwise(F.col("path")).alias("path"), "verdict", "rule")
    one = one.groupBy("kind", "host", "path").agg(F.max_by(F.struct("verdict", "rule"), F.struct("verdict", "rule")).alias("e")).select("kind", "host", "path", "e.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"exact": EXACT, "site": SITE, "prefix": PREFIX}
        for b in batches:
            at, kinds, hashes = [], [], []
            for k, (kind, h, p) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                end, none = _whole(h, True), np.zeros(1, np.uint64)
                for code, path in [(names[kind], none if kind == "site" else _whole(p)), *([(HOST, none)] if kind == "prefix" else [])]:
                    at.append(k)
                    kinds.append(code)
                    hashes.append(mixed(code, end, path)[0])
            taken = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(kinds, pa.int32()), *taken.columns[1:]], names=["h", "key", "k_host", "k_path", "verdict", "rule"])

    return one.mapInArrow(run, "h long, key int, k_host string, k_path string, verdict string, rule string").withColumns({"plen": F.length("k_path"), "hlen": F.length("k_host")})


def masks(h: np.ndarray) -> np.ndarray:
    """(keys, WORDS) bits of each key in its block."""
    return np.uint32(1) << ((h & _U(0xFFFFFFFF)).astype(np.uint32)[:, None] * _ODD >> np.uint32(27))


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(blocks) >> _U(32)).astype(np.int64)


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter as rows (block, words): each task ORs its keys, Spark ORs the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            order = np.argsort(at := block_of(h, blocks), kind="stable")
            some, first = np.unique(at[order], return_index=True)
            words = np.bitwise_or.reduceat(masks(h)[order], first, axis=0) if len(some) else np.zeros((0, WORDS), np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(words[:, i].astype(np.int64)) for i in range(WORDS))], names=["block", *(f"w{i}" for i in range(WORDS))])

    made = keys.select("h").mapInArrow(run, "block long, " + ", ".join(f"w{i} long" for i in range(WORDS)))
    return made.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


class Filter:
    """The broadcast filter with the listed prefix lengths."""

    def __init__(self, held: np.ndarray, lengths: np.ndarray):
        self.held, self.lengths = held, lengths
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.exact: dict[str, np.uint64] = {}

    def passes(self, h: np.ndarray) -> np.ndarray:
        bits = masks(h)
        return (self.held[block_of(h, len(self.held))] & bits == bits).all(axis=1)

    def of_host(self, host: str) -> tuple[np.ndarray, np.ndarray]:
        """(possible site keys, hashes of the suffixes that may be hosts of prefix entries); hosts repeat, so they are kept."""
        found = self.known.get(host)
        if found is None:
            ends = host_suffixes(host)
            sites = mixed(SITE, ends, _U(0))
            found = sites[self.passes(sites)], ends[self.passes(mixed(HOST, ends, _U(0)))]
            if len(host) < 256:
                if len(self.known) >= KEPT_HOSTS:
                    self.known.clear()
                self.known[host] = found
        return found

    def of_canonical(self, host: str) -> np.uint64:
        found = self.exact.get(host)
        if found is None:
            found = _whole(host, True)[0]
            if len(host) < 256:
                if len(self.exact) >= KEPT_HOSTS:
                    self.exact.clear()
                self.exact[host] = found
        return found

    def hits(self, pages: Iterable[tuple[str, str, str, str]]) -> list[np.ndarray]:
        """The keys of each page (host, path, canonical host and path) that may be listed."""
        out: list[list] = []
        e_host, e_path, e_of = [], [], []
        p_host, p_path, p_of, held = [], [], [], 0

        def ask() -> None:
            for kind, hosts, paths, owners in ((EXACT, np.array(e_host, np.uint64), np.array(e_path, np.uint64), np.array(e_of, np.int64)), (PREFIX, *(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (p_host, p_path, p_of)))):
                if len(hosts):
                    asked = mixed(kind, hosts, paths)
                    for k in np.flatnonzero(self.passes(asked)).tolist():
                        out[int(owners[k])].append(asked[k])
            for x in (e_host, e_path, e_of, p_host, p_path, p_of):
                x.clear()

        for n, (host, path, c_host, c_path) in enumerate(pages):
            if not host:
                out.append([])
                continue
            sites, rest = self.of_host(host)
            out.append(list(sites))
            starts = prefix_hashes(path)
            e_host.append(self.of_canonical(c_host))
            e_path.append(starts[len(c_path)])  # the canonical path is a prefix of the path
            e_of.append(n)
            if len(rest):
                asked = starts[self.lengths[: np.searchsorted(self.lengths, len(path), "right")]]
                p_host.append(np.repeat(rest, len(asked)))
                p_path.append(np.tile(asked, len(rest)))
                p_of.append(np.full(len(asked) * len(rest), n))
                held += len(asked) * len(rest)
                if held > ASKED_AT_ONCE:
                    ask()
                    held = 0
        ask()
        return [np.array(x, np.uint64) for x in out]


def _exploded(pages: DataFrame, keys: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """(_row, _h): the possible keys of pages by a filter that stays distributed; prefixes come after their hosts are found."""

    @F.pandas_udf("array<long>")
    def first(host, c_host, c_path):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for h, a, b in zip(host, c_host, c_path, strict=True):
            ends = host_suffixes(h) if h else np.zeros(0, np.uint64)
            own = [mixed(HOST, ends, _U(0)), mixed(SITE, ends, _U(0)), *([mixed(EXACT, _whole(a, True), _whole(b))] if h else [])]
            out.append(np.concatenate(own).view(np.int64))
        return pd.Series(out)

    @F.pandas_udf("array<long>")
    def second(k_host, path, lengths):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for h, p, n in zip(k_host, path, lengths, strict=True):
            starts = prefix_hashes(p)
            n = np.asarray(n, np.int64)
            out.append(mixed(PREFIX, _whole(h, True), starts[n[n < len(starts)]]).view(np.int64))
        return pd.Series(out)

    @F.pandas_udf("long")
    def block(h):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(block_of(h.to_numpy().view(np.uint64), blocks))

    @F.pandas_udf("boolean")
    def fits(h, w):  # noqa: ANN001, ANN202
        import pandas as pd

        bits = masks(h.to_numpy().view(np.uint64))
        words = np.stack([np.asarray(x, np.int64) for x in w]).astype(np.uint32) if len(w) else np.zeros((0, WORDS), np.uint32)
        return pd.Series((words & bits == bits).all(axis=1))

    words = bloom.select("block", F.array(*(f"w{i}" for i in range(WORDS))).alias("w"))

    def possible(asked: DataFrame) -> DataFrame:
        flat = asked.select("_h").distinct()
        there = flat.withColumn("block", block("_h")).join(words, "block").where(fits("_h", "w")).select("_h")
        return asked.join(there, "_h", "left_semi")

    asked = shared_table(possible(pages.select("_row", F.explode(first("host", *canonical(F.col("host"), F.col("path")))).alias("_h"))), "asked")
    lengths = keys.where(F.col("key") == PREFIX).groupBy("k_host").agg(F.collect_set("plen").alias("lengths"))
    hosts = keys.where(F.col("key") == HOST).select(F.col("h").alias("_h"), "k_host").distinct().join(lengths, "k_host")
    under = pages.select("_row", "path").join(asked.join(hosts, "_h").select("_row", "k_host", "lengths"), "_row")
    return asked.union(possible(under.select("_row", F.explode(second("k_host", "path", "lengths")).alias("_h"))))


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """All columns of pages with host, path, rule and verdict.

    listed: (verdict allow or block, rule, host, path, kind prefix, exact or site).
    """
    keys = shared_table(keyed(listed), "listed")
    n = keys.count()
    blocks = max(1, -(-n * BITS_PER_KEY // (32 * WORDS)))
    bloom = bloom_blocks(keys, blocks)
    parted = with_parts(pages, url_col)
    own = parted.columns
    here = canonical(F.col("host"), F.col("path"))
    if n <= FILTER_KEYS:
        held = np.zeros((blocks, WORDS), np.uint32)
        for r in bloom.collect():  # at most FILTER_KEYS / 16 rows
            held[r.block] = r[1:]
        lengths = sorted(r.plen for r in keys.where(F.col("key") == PREFIX).select("plen").distinct().collect())  # fewer than keys
        filter_ = Filter(held, np.array(lengths, np.int64))

        @F.pandas_udf("array<long>")
        def hits(host, path, c_host, c_path):  # noqa: ANN001, ANN202
            import pandas as pd

            return pd.Series([x.view(np.int64) for x in filter_.hits(zip(host, path, c_host, c_path, strict=True))], dtype=object)

        asked = parted.withColumn("_hits", hits("host", "path", *here))
        clear = asked.where(F.size("_hits") == 0).drop("_hits")
        some = asked.where(F.size("_hits") > 0).withColumn("_row", F.monotonically_increasing_id())
        rows = some.select(*own, "_row", F.explode("_hits").alias("_h"))
    else:
        some = shared_table(parted.withColumn("_row", F.monotonically_increasing_id()), "pages")
        asked = _exploded(some, keys, bloom, blocks)
        clear = some.join(asked.select("_row").distinct(), "_row", "left_anti").select(*own)
        rows = some.join(asked, "_row").select(*own, "_row", "_h")
    fits = (
        F.when(F.col("_kind") == EXACT, (here[0] == F.col("_khost")) & (here[1] == F.col("_kpath")))
        .when(F.col("_kind") == HOST, F.lit(False))
        .otherwise(((F.col("host") == F.col("_khost")) | F.endswith("host", F.concat(F.lit("."), "_khost"))) & ((F.col("_kind") == SITE) | F.startswith("path", "_kpath")))
    )
    entry = F.struct(F.array_position(F.array(*map(F.lit, (SITE, EXACT, PREFIX))), F.col("_kind")), F.col("_hlen").alias("hlen"), F.col("_plen").alias("plen"), F.col("_verdict").alias("verdict"), F.col("_rule").alias("rule"))
    listed_keys = keys.withColumnsRenamed({"h": "_h", "key": "_kind", "k_host": "_khost", "k_path": "_kpath", "verdict": "_verdict", "rule": "_rule", "hlen": "_hlen", "plen": "_plen"})
    small = F.broadcast(listed_keys) if n <= 100_000 and keys.agg(F.coalesce(F.sum(F.col("hlen") + F.col("plen")), F.lit(0))).first()[0] <= 16 << 20 else listed_keys
    named = [c for c in own if c in ("verdict", "rule")]
    rows = rows.drop(*named).join(small, "_h", "left").withColumn("_e", F.when(fits, entry))
    kept = [c for c in own if c not in named]
    best = rows.groupBy("_row").agg(*(F.first(c).alias(c) for c in kept), F.max("_e").alias("_e"))
    order = [*kept, "rule", "verdict"]
    best = best.withColumn("rule", F.col("_e.rule")).withColumn("verdict", F.coalesce("_e.verdict", F.lit("allow")))
    return best.select(*order).unionByName(clear.drop(*named).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")}).select(*order))


def pages_of_documents(pages: DataFrame, doc_ids: DataFrame, url_col: str = "url", id_col: str = "doc_id") -> DataFrame:
    """Blocked exact entries for the pages that serve one of the documents, by the number behind the language in their path."""
    number = F.regexp_extract("path", "^/[a-z]+/([0-9]+)", 1).try_cast("long")
    served = with_parts(pages.select(url_col), url_col).select("host", "path", number.alias("_id")).where("host <> ''")
    ids = doc_ids.select(F.col(id_col).cast("long").alias("_id")).where("_id is not null").distinct()
    host, path = canonical(F.col("host"), F.col("path"))
    found = served.join(ids, "_id", "left_semi").select(host.alias("host"), path.alias("path")).distinct()
    return found.select(F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("rule"), "host", "path", F.lit("exact").alias("kind"))
