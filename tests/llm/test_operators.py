"""Each operator against a brute-force version, and on awkward rows."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
import corpus_pipeline
from traitscan.llm import bpe, editcounts, embeddings, langid, linededup, minhash, packing, queries, search, sharding, urlfilter
from traitscan.llm.common import are_stars, connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort " * 60_000


def docs_of(spark, texts, schema=DOC):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_bpe_path())


AWKWARD = ["", None, " ", "a", "Hello it's <|endoftext|> a²b Ñandú 12 …—don't'stop \x1cq İx Σας", "日本語 テスト <|startoftext|><|endoftext|>x", "a\x85b\xa0c　d​e", "é́ " * 50, "x" * 3000, "ñóq" * 100, "same text", "same text", LONG]


# ------------------------------------------------------------ 6 and 7


def test_bpe_equals_the_library(spark, tok):
    docs = docs_of(spark, AWKWARD).withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in bpe.encode_documents(docs, queries.word_bpe_path(), keep="ids").collect()}
    for i, t in enumerate(AWKWARD):
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == want, t
        assert got[i].decoded == tok.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(docs.limit(0), queries.word_bpe_path()).count() == 0


def test_bpe_fragments_and_windows(tok, monkeypatch):
    b = bpe.WordBpe(queries.word_bpe_path())
    assert len(b.fragments("xqñ".encode())) > 1 and b"".join(b.fragments("xqñ".encode())) == "xqñ".encode()
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    monkeypatch.setattr(bpe, "WINDOW_CHARS", 50)
    rng = random.Random(1)
    for _ in range(60):
        t = "".join(rng.choice(["ab", "the ", "don't", "é", "\n", " ", "x1", "...", "Σ", "日本", "<|endoftext|>", "jq", "vz"]) for _ in range(rng.choice([1, 40, 200])))
        assert np.frombuffer(b.encode([t, "z", t])[2], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_query_op6(spark, tok):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op6_bpe(spark, DATA).collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def plain_best_fit(sizes, window):
    """Best fit decreasing, one piece after the other."""
    left = []
    for s in sorted(sizes, reverse=True):
        fit = [x for x in left if x >= s]
        if fit:
            left.remove(min(fit))
            left.append(min(fit) - s)
        else:
            left.append(window - s)
    return sorted(left)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for window in (7, 16, 100):
        for _ in range(40):
            sizes = [rng.randint(1, window) for _ in range(rng.randint(0, 120))]
            runs = packing.best_fit_plan(dict(collections.Counter(sizes)), window)
            fill, ends = collections.Counter(), {}
            counts = collections.Counter(sizes)
            spans = collections.defaultdict(list)
            for length, at, per, first, offset in sorted(runs):
                spans[length].append((at, per, first, offset))
            for length, n in counts.items():
                for j in range(n):
                    at, per, first, offset = [x for x in spans[length] if x[0] <= j][-1]
                    w, o = first + (j - at) // per, offset + (j - at) % per * length
                    fill[w] += length
                    ends.setdefault(w, []).append((o, o + length))
            assert sorted(window - v for v in fill.values()) == plain_best_fit(sizes, window)
            for parts in ends.values():
                parts.sort()
                assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


def check_packing(rows, texts, tok, window=4096):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids, at = np.array([*tok.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window


def test_query_op7(spark, tok):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op7_packing(spark, DATA).collect()
    check_packing(rows, texts, tok)
    assert max(r.sequence_id for r in rows) + 1 <= 1.02 * sum(r.length for r in rows) / 4096 + 2
    docs = docs_of(spark, AWKWARD).withColumn("offset", F.lit("clash"))
    check_packing(packing.pack_documents(docs, queries.word_bpe_path()).collect(), dict(enumerate(AWKWARD)), tok)
    assert packing.pack_documents(docs.limit(0), queries.word_bpe_path()).count() == 0


# ------------------------------------------------------------ 3


def test_edits_equal_fresh_counts(spark, tok):
    texts = [t for t in AWKWARD if t != LONG]
    edits = [[(3, 2, "été"), (0, 0, "x y "), (10**9, 5, " end"), (1, 10**9, None)], None, [], [(0, 0, "long insert " * 200), (700, 5, "'")]]
    rows = [(i, t, edits[i % 4]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<pos:long,n_del:long,ins:string>>").withColumn("n_edits", F.lit("clash"))
    got = {r.doc_id: r for r in editcounts.edited_counts(docs, queries.word_bpe_path()).collect()}
    for i, t, es in rows:
        t = t or ""
        assert got[i].n_tokens_before == len(tok.encode(t, add_special_tokens=False).ids)
        for pos, gone, ins in es or []:
            pos = min(pos, len(t))
            t = t[:pos] + (ins or "") + t[pos + gone :]
        assert got[i].n_tokens_after == len(tok.encode(t, add_special_tokens=False).ids)
    table = spark.createDataFrame([(1, 2, 0, 0, "b"), (1, 1, 0, 0, "a")], "doc_id long, seq long, pos long, n_del long, ins string")
    assert [e.ins for e in editcounts.attach_edits(docs.drop("edits"), table).where("doc_id = 1").first().edits] == ["a", "b"]


def test_edits_touch_little(spark):
    b = bpe.WordBpe(queries.word_bpe_path())
    tree = editcounts.TokenTree(b, "some words here " * 20_000)
    tree.edit(150_000, 3, "new")
    assert tree.encoded < 2000
    signs = editcounts.TokenTree(b, "a-b;c1d=2," * 30_000)  # no white space
    signs.edit(150_000, 3, "new")
    assert signs.encoded < 2000 and len(signs.leaves) > 500


def test_edits_without_white_space(tok):
    b = bpe.WordBpe(queries.word_bpe_path())
    rng = random.Random(7)
    parts = ["a", "bc", "don't", "'s", "1", "23", "x1y", ".", ",", "--", "'", "É", "é", "́", "Σ", "日本", "<|endoftext|>", "<|end", "|>", " ", "\n", "_", "=", "²"]
    for _ in range(80):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([5, 200, 900])))
        tree = editcounts.TokenTree(b, text)
        for _ in range(4):
            pos, gone, ins = rng.randrange(len(text) + 3), rng.choice([0, 1, 3, 300]), "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 4, 400])))
            tree.edit(pos, gone, ins)
            pos = min(pos, len(text))
            text = text[:pos] + ins + text[pos + gone :]
            assert tree.total == len(tok.encode(text, add_special_tokens=False).ids), text


def test_query_op3(spark, tok):
    rows = queries.op3_token_counts(spark, DATA).collect()
    source = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("edits", editcounts.hashed_edits())
    want = {}
    for r in source.collect():
        t = r.text
        before = len(tok.encode(t, add_special_tokens=False).ids)
        for e in r.edits:
            t = t[: e.pos] + e.ins + t[e.pos + e.n_del :]
        want[r.doc_id] = (before, len(tok.encode(t, add_special_tokens=False).ids), 3)
    assert {r.doc_id: (r.n_tokens_before, r.n_tokens_after, r.n_edits) for r in rows} == want


# ------------------------------------------------------------ 2


def test_sharding(spark):
    texts = [None, "", *["copy " * 50] * 200, *(f"doc {i} " * (i % 40) for i in range(400)), LONG[:20_000]]
    docs = docs_of(spark, texts).withColumn("bin", F.lit("clash")).withColumns({"size": F.lit("old"), "shard": F.lit("old")})
    rows = sharding.histogram_shards(docs, 6).collect()
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 8 and r.bin == "clash"
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts) and len(size) == 6
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) < 20_000 + 0.1 * sum(size.values()) / 6
    assert sharding.histogram_shards(docs.limit(0), 6).count() == 0
    assert sharding.histogram_shards(docs_of(spark, ["one"]), 6).first().slot == 0
    same = spark.createDataFrame([(7, "t")] * 50 + [(None, "t")], "doc_id long, text string")
    assert sharding.histogram_shards(same, 3).count() == 51
    assert set(collections.Counter(r.shard for r in sharding.histogram_shards(same, 3).collect()).values()) <= {16, 17, 18}


@pytest.mark.parametrize("per_bin", [0, 20])
def test_sharding_of_repeated_rows(spark, per_bin):
    """300 copies of one row and 30 others: a boundary goes through the copies, many tasks number them."""
    rows = [(7, "t" * 20, k) for k in range(300)] + [(k, f"other {k}", k) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(4)
    got = sharding.histogram_shards(docs, 3, rows_per_bin=per_bin).collect()
    held, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted((r.doc_id, r.text, r.extra) for r in got) == sorted(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(held) == 3 and max(held.values()) - min(held.values()) <= 2 * 28 + 0.02 * sum(held.values()) / 3


def test_packing_of_null_and_repeated_ids(spark, tok):
    docs = spark.createDataFrame([(None, "a b c d")] * 60 + [(3, "a b c d")] * 60 + [(None, None)] * 5, "doc_id long, text string").repartition(3).withColumn("_row", F.lit("clash"))
    rows = packing.pack_documents(docs, queries.word_bpe_path(), window=16).collect()
    assert len(rows) == 125 and sum(r.length for r in rows) == 120 * 5 + 5
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.offset + r.length))
    for parts in windows.values():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] <= 16 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    pieces = packing.cut_documents(docs, queries.word_bpe_path(), 16, 2).withColumn("n", F.monotonically_increasing_id())
    assert sorted(r.offset for r in packing.pack_pieces(pieces, 16, rows_per_bucket=5, row_col="n").collect()) == sorted(r.offset for r in rows)


def test_query_op2(spark):
    rows = queries.op2_sharding(spark, DATA).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    shards = collections.defaultdict(set)
    for r in rows:
        assert r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None
        shards[r.shard].add(r.slot)
    assert len(rows) == len(text) and all(s == set(range(len(s))) for s in shards.values())
    held = collections.Counter()
    for r in rows:
        assert r.size == len(text[r.doc_id].encode()) + 8
        held[r.shard] += r.size
    goal = sum(held.values()) / 24
    assert all(abs(held[s] - goal) <= 0.02 * goal + max(r.size for r in rows) for s in range(24))


# ------------------------------------------------------------ 4


def test_line_dedup(spark):
    page = lambda *xs: "\n".join(xs)
    rows = [(i, page("menu", f"own {i}", "menu", ""), "h", "x") for i in range(10)] + [(20, None, "h", "x"), (21, "", "h", "x"), (22, "menu", None, "x"), (23, "menu", "h2", "x"), (24, "menu", "h", "x"), (25, LONG, "h", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host string")
    got = {r.doc_id: r for r in linededup.drop_boilerplate(df, 0.5, 3).collect()}
    assert got[3].text == "own 3\n" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert (got[20].text, got[20].n_lines, got[20].n_dropped) == (None, 0, 0)
    assert (got[21].text, got[21].n_lines) == ("", 1)
    assert got[22].text == got[23].text == "menu" and got[24].text == "" and got[25].text == LONG and got[25].host == "x"
    assert linededup.drop_boilerplate(df.limit(0)).count() == 0
    odd = df.withColumn("n_lines", F.lit("old"))
    assert odd.count() == linededup.drop_boilerplate(odd, 0.5, 3).where("n_lines >= 0").count()
    assert {r.n_lines for r in linededup.drop_boilerplate(odd, 0.5, 3, counts=False).collect()} == {"old"}


def test_copies_do_not_vote_their_lines_out(spark):
    rows = [(i, "one line of its own", "s") for i in range(5)] + [(10 + i, f"own {i}\nfooter", "s") for i in range(20)] + [(40, "footer", "s"), (41, "\n", "s"), (42, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n_chars": F.lit(0).cast("long"), "lang": F.lit("en"), "n_lines": F.lit("own")})
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, df, DATA).collect()}
    assert got == {**{i: "one line of its own" for i in range(5)}, **{10 + i: f"own {i}" for i in range(20)}, 41: "\n", 42: None}
    assert corpus_pipeline.lines(spark, df, DATA).columns == df.columns and corpus_pipeline.lines(spark, df.limit(0), DATA).count() == 0


def test_lines_of_a_few_per_cent_go(spark):
    lines = {"en": ("All rights reserved.", 31), "fr": ("Tous droits réservés.", 37), "de": ("Alle Rechte vorbehalten.", 41), "es": ("Todos los derechos reservados.", 43)}
    rows = [(i, "hot" if i < 700 else f"s{i % 2}", f"own {i}\n" + "".join(f"{x}\n" for x, every in lines.values() if i % every == 0) + ("rare\n" if i in (5, 6, 900) else "")) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, df.withColumn("n_chars", F.lit(0)), DATA).collect()}
    assert got == {i: f"own {i}\n" + ("rare\n" if i in (5, 6, 900) else "") for i, _, _ in rows}


# ------------------------------------------------------------ 5


def slow_verdict(url, rules, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    best = max(((len(h), len("/" + p), v, r) for v, r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)), default=None)
    return host, path, best[3] if best else None, best[2] if best else "block" if (host, path) in listed else "allow"


@pytest.mark.parametrize("small", [True, False])
def test_url_filter(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(urlfilter, "FILTER_KEYS", 0)
    urls = ["http://A.example.ORG/es/x", "https://example.org/en/12?q", "https://xexample.org/es/", "http://a.b.com/fr/1#f", "http://a.b.com/de/", "http://a.com", None, "", "no url", "x://", "http://ads.net/p", "http://ads.net/q", "http://h/" + "p" * 5000, "http://a.com/de/", "http://a.com/de/", "s://u?://v/w"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string")
    listed = urlfilter.rule_table(spark, queries.URL_RULES)
    extra = spark.createDataFrame([("block", None, "ads.net", "/p", "exact")], "verdict string, rule string, host string, path string, kind string")
    got = {r.page_id: r for r in urlfilter.judge(pages, listed.select(*extra.columns).union(extra)).collect()}
    assert len(got) == len(urls)
    for i, u, _ in rows:
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == slow_verdict(u, queries.URL_RULES, {("ads.net", "/p")}), u
        assert r.key == "clash"
    assert urlfilter.judge(pages.limit(0), listed).count() == 0
    odd = spark.createDataFrame([(1, "http://a.bad.net/x\ny?z", "c"), (2, "http://bad.net.org/", "c"), (3, "http://sub.ok.net/q", "c"), (4, "http://bad.net/ok/1", "c")], "page_id long, url string, host string").withColumns({"rule": F.lit(7), "verdict": F.lit(8)})
    rules = urlfilter.rule_table(spark, [("block", "ok.net"), ("allow", "bad.net/ok/")]).select(*extra.columns).union(urlfilter.site_table(spark, ["bad.net"]).select(*extra.columns))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(odd, rules).collect())
    assert got == [(1, "a.bad.net", "/x\ny", None, "block"), (2, "bad.net.org", "/", None, "allow"), (3, "sub.ok.net", "/q", "ok.net", "block"), (4, "bad.net", "/ok/1", "bad.net/ok/", "allow")]


def test_url_filter_with_very_many_prefix_lengths(spark):
    listed = spark.range(1, 6001).select(F.lit("block").alias("verdict"), F.col("id").cast("string").alias("rule"), F.lit("x").alias("host"), F.concat(F.lit("/"), F.repeat(F.lit("a"), F.col("id").cast("int"))).alias("path"), F.lit("prefix").alias("kind"))
    pages = spark.createDataFrame([(i, "http://x/" + "a" * i) for i in range(50, 6000, 500)], "page_id long, url string")
    assert {r.page_id: r.rule for r in urlfilter.judge(pages, listed).collect()} == {r.page_id: str(r.page_id) for r in pages.collect()}


@pytest.mark.parametrize("small", [True, False])
def test_url_filter_exact_entries_and_long_urls(spark, monkeypatch, small):
    """Canonical forms; a host of 16,000 labels and a path of 1,000,000 characters in seconds."""
    if not small:
        monkeypatch.setattr(urlfilter, "FILTER_KEYS", 0)
    urls = ["http://www.A.net:443/x//", "https://a.net/x?q#f", "http://b.a.net/x", "http://a.net/x/y", "ftp://a.net:80/x/", "http://a.net:8080/x"]
    urls += ["http://" + "a." * 16_000 + "listed.org/z", "http://h.net/" + "p/" * 500_000 + "?q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    schema = "verdict string, rule string, host string, path string, kind string"
    entries = [("block", None, "a.net", "/x/", "exact"), ("block", "listed.org/z", "listed.org", "/z", "prefix"), ("block", None, "a." * 15_000 + "listed.org", "", "site")]
    entries += [("block" if k % 2 else "allow", str(k), "h.net", "/" + "p/" * k, "prefix") for k in range(1, 2000, 7)]
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, spark.createDataFrame(entries, schema)).collect()}
    assert [got[k][1] for k in range(6)] == ["block", "block", "allow", "allow", "block", "allow"]
    assert got[6] == ("listed.org/z", "block") and got[7] == ("1996", "allow")
    assert time.time() - began < 60


def test_url_filter_false_hits_are_few(spark):
    listed = [("block", None, f"h{k % 50}.net", f"/p/{k}", "exact") for k in range(5000)]
    keys = urlfilter.keyed(spark.createDataFrame(listed, "verdict string, rule string, host string, path string, kind string"))
    blocks = 5000 * urlfilter.BITS_PER_KEY // 256
    held = np.zeros((blocks, urlfilter.WORDS), np.uint32)
    for r in urlfilter.bloom_blocks(keys, blocks).collect():
        held[r.block] = r[1:]
    f = urlfilter.Filter(held, np.array([1], np.int64))
    assert all(len(x) == 1 for x in f.hits((h, p, h, p) for _, _, h, p, _ in listed[:500]))
    false = sum(map(len, f.hits((h, p, h, p) for h, p in ((f"h{k % 50}.net", f"/q/{k}") for k in range(5000)))))
    assert false < 0.01 * 5000 * 4  # of four keys a page or so


def test_toxic_pages_are_listed(spark):
    pages = spark.createDataFrame([("http://www.a.net/en/5?x",), ("http://b.net/de/6.html",), ("http://b.net/de/7",), ("http://b.net/x",), (None,)], "url string")
    ids = spark.createDataFrame([(5,), (6,), (None,), (99,)], "doc_id long")
    assert {(r.host, r.path, r.kind) for r in urlfilter.pages_of_documents(pages, ids).collect()} == {("a.net", "/en/5", "exact"), ("b.net", "/de/6.html", "exact")}


def test_bloom_has_no_false_negatives():
    h = np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64)
    blocks = 5000 * urlfilter.BITS_PER_KEY // 256
    words = np.zeros((blocks, urlfilter.WORDS), np.uint32)
    at = urlfilter.block_of(h, blocks)
    np.bitwise_or.at(words, at, urlfilter.masks(h))
    assert (words[at] & urlfilter.masks(h) == urlfilter.masks(h)).all()
    other = np.random.default_rng(2).integers(0, 1 << 64, 50_000, dtype=np.uint64)
    bits = urlfilter.masks(other)
    assert (words[urlfilter.block_of(other, blocks)] & bits == bits).all(axis=1).mean() < 0.01


# ------------------------------------------------------------ 8


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def slow_components(texts, width, percent):
    sets = []
    for t in texts:
        w = words_of(t)
        n = min(width, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_texts(n=150, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n // 6):
        base = [rng.choice("abcdefghij") * rng.randint(1, 4) + str(rng.randint(0, 60)) for _ in range(rng.choice([3, 12, 80]))]
        for _ in range(6):
            w = base[:]
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 9)}"
            out.append(" ".join(w).upper() if rng.random() < 0.2 else "\t".join(w))
    return out


@pytest.mark.parametrize(("width", "shingles"), [(2, 1_000_000), (5, 1_000_000), (2, 150)])
def test_minhash_against_all_pairs(spark, monkeypatch, width, shingles):
    monkeypatch.setattr(minhash, "TASK_SHINGLES", shingles)
    texts = [*near_texts(), "", None, "one", "one", "ONE ", "É", "é", " \n", LONG, LONG + "x"]
    docs = docs_of(spark, texts).withColumn("nid", F.lit("clash"))
    want, sizes = slow_components(texts, width, 80)
    got = {r.id: r for r in minhash.near_duplicates(docs, width=width).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].component_id, got[i].n_shingles, got[i].kept, got[i]["first"]) == (want[i], sizes[i], want[i] == i, want[i] == i)
    kept = minhash.keep_one(docs, width=width)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == docs.columns
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words are here now"), (None, "a b c d e f"), (2, "a b c d e f"), (None, "alone in the wide world")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, width=2).collect()
    assert sorted((str(r.id), str(r.component_id), r["first"]) for r in got) == sorted([("1", "1", True), ("1", "1", False), ("1", "1", True), ("None", "1", False), ("2", "1", False), ("None", "None", True)])
    assert sorted(str(r.text) for r in minhash.keep_one(docs, width=2).collect()) == ["a b c d e f", "alone in the wide world", "other words are here now"]


def test_common_shingles_are_counted_exactly():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < p], rng.integers(0, 1 << 60, 20, dtype=np.uint64)])) for p in rng.random(60)]
    sets[7] = sets[7][:0]
    got = np.concatenate([m for _, m in minhash.common_counts(sets[:25], sets)])
    assert (got == [[len(np.intersect1d(u, v)) for v in sets] for u in sets[:25]]).all()


def test_minhash_of_a_loose_group(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    texts = []
    for _ in range(160):
        w = base[:]
        for _ in range(rng.choice([1, 4, 7, 9, 11, 14])):
            w[rng.randrange(120)] = f"w{rng.randint(0, 40)}"
        texts.append(" ".join(w))
    want, _ = slow_components(texts, 2, 80)
    assert len(set(want)) > 20 and max(collections.Counter(want).values()) > 40
    for shingles in (1_000_000, 3000):
        monkeypatch.setattr(minhash, "TASK_SHINGLES", shingles)
        got = {r.id: r.component_id for r in minhash.near_duplicates(docs_of(spark, texts), width=2).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_query_op8(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    want, sizes = slow_components([t for _, t in docs], 2, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op8_minhash(spark, DATA).collect()}
    assert got == {i: (sizes[k], docs[want[k]][0], want[k] == k) for k, (i, _) in enumerate(docs)}


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (50, 50)], "a long, b long")
    got = dict(tuple(r) for r in connected_components(e).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert connected_components(e.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 60, (25 + 10 * seed, 2))]
    parent = list(range(60))
    for _ in range(60):  # labels fall until nothing changes
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {v: parent[v] for p in pairs if p[0] != p[1] for v in p}


def test_stars_need_no_round(spark):
    stars = lambda pairs: are_stars(spark.createDataFrame(pairs, "u long, v long"))
    assert stars([(5, 1), (6, 1), (7, 2)]) and stars([])
    assert not stars([(5, 1), (5, 2)]) and not stars([(5, 3), (3, 1)])


# ------------------------------------------------------------ 9


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = queries.op9_language(spark, DATA).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95
    odd = docs_of(spark, ["", None, "123 !!", "Ñ", LONG]).withColumns({"score": F.lit("clash"), "n_grams": F.lit("clash"), "lang_pred": F.lit("clash")})
    protos = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(odd, protos).collect()}
    assert 0 <= got[3].score <= 1 and got[3].source == "s"
    assert [got[i].lang_pred == "und" for i in range(5)] == [True, True, True, False, False]
    assert {r.lang_pred for r in langid.identify(odd, langid.train(docs.limit(0))).collect()} == {"und"}
    assert langid.identify(docs.limit(0), protos).count() == 0
    more = docs.limit(30).withColumns({"doc_id": F.col("doc_id") + 100, "score": F.lit("own"), "n_grams": F.lit("own"), "lang_pred": F.lit("own")})
    kept = langid.keep_language(odd.unionByName(more))
    assert kept.columns == odd.columns and sorted((r.doc_id, r.score, r.lang_pred) for r in kept.where("doc_id < 100").collect()) == [(3, "clash", "clash"), (4, "clash", "clash")]


def test_query_op9_by_plain_sums(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    seen: dict[int, np.ndarray] = {}

    def letter(c):
        if c not in seen:
            rng = np.random.Generator(np.random.PCG64([5, c]))
            seen[c] = rng.integers(0, 2, langid.DIM, dtype=np.int8) * np.int8(2) - np.int8(1)
        return seen[c].astype(int)

    def bundle(text):
        low = re.sub(r"[\W\d_]+", " ", text)
        codes = [0, *(ord(ch.lower()[0]) if ch != " " else 0 for ch in low), 0]
        grams = collections.Counter(zip(codes, codes[1:], codes[2:], strict=False))
        return sum((n * np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for (a, b, c), n in grams.items()), np.zeros(langid.DIM))

    some = [r for r in docs if re.fullmatch(r"[\w\s.,;:!?'-]*", r.text) and not re.search("ª|º", r.text)][:40]
    sums = collections.defaultdict(lambda: np.zeros(langid.DIM))
    for r in some:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            sums[r.lang] += bundle(r.text)
    langs = sorted(sums)
    unit = np.array([sums[k] / np.linalg.norm(sums[k]) for k in langs])
    mean = unit.mean(axis=0)
    unit = unit - mean
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    df = spark.createDataFrame(some)
    got = {r.doc_id: r for r in langid.identify(df, langid.train(df.where(~queries.held_out_third()))).collect()}
    for r in some:
        v = bundle(r.text)
        v = v / np.linalg.norm(v) - mean
        cosine = unit @ v / np.linalg.norm(v)
        assert got[r.doc_id].lang_pred == langs[int(cosine.argmax())]
        assert got[r.doc_id].score == pytest.approx((1 + cosine.max()) / 2, abs=1e-5)


def test_languages_of_other_alphabets_and_the_empty_name(spark):
    rng = random.Random(1)
    alphabets = {"": "abcdefgh", "el": "αβγδεζηθ", "ru": "абвгдежз", "zh": "日本語中文字典", "he": "אבגדהוזח"}
    text = lambda a: " ".join("".join(rng.choice(a) for _ in range(4)) for _ in range(30))
    rows = [(i, text(a), lang) for i, (lang, a) in enumerate(sorted(alphabets.items()) * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, langid.train(df.where("doc_id % 2 = 0"))).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_junk_is_no_language(spark):
    rng = np.random.default_rng(3)
    words = {"en": "the of and that with from have this their which there would about other into could these".split(), "de": "der die und nicht werden eine auch sich nach wird einer durch zwischen schon wieder".split()}
    text = lambda lang: " ".join(rng.choice(words[lang], 150))
    clean = [(i, text("de" if i % 3 else "en"), "de" if i % 3 else "en") for i in range(450)]
    clean += [(500 + i, " ".join(rng.choice(words["en"], 2)), "en") for i in range(20)]  # short ones stay
    junk = ["".join(rng.choice(list("qxzjkvwy "), 900)), "the " * 300, " ".join(w + "$$$%%" for w in text("de").split())]
    odd = [(900 + i, x, "en") for i, x in enumerate(junk)] + [(950, "123 456 !!", "en")]
    df = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")
    kept = langid.keep_language(df)
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in clean] and kept.columns == df.columns
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_language(bare).count() == len(clean + odd)


def test_bundles_are_sums_of_bound_vectors():
    p = langid.Profiles()
    codes, counts = np.unique(langid.grams("abc abd"), return_counts=True)
    want = sum(n * p.vectors(np.array([c]))[0].astype(float) for c, n in zip(codes, counts, strict=True))
    assert np.allclose(p.bundle(codes, counts), want)


# ------------------------------------------------------------ 10


def slow_vectors(rows, cosine):
    n = len(rows)
    unit = []
    for _, v, lab in rows:
        ok = lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok else None)
    hit = lambda i, j: unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= cosine
    links, root = [0] * n, list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(n):
        for j in range(i):
            if hit(i, j):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(n)]


@pytest.mark.parametrize("block_rows", [2000, 16])
def test_embeddings_against_all_pairs(spark, block_rows):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(30):
        base = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 9))):
            rows.append([(base * rng.uniform(0.1, 5) + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.12])).astype(np.float32).tolist(), g % 3])
    rows += [[rows[0][0], 0]] * 20 + [[None, 0], [[0.0] * 8, 0], [[float("nan")] * 8, 0], [[1.0, None], 0], [rows[0][0], None], [[1.0, 2.0], 0], [[2.0, 4.0], 0], [[], 0]]
    rows = [(i, v, lab) for i, (v, lab) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    links, comp = slow_vectors(rows, 0.98)
    got = {r.vec_id: r for r in embeddings.near_vectors(df, 0.98, block_rows=block_rows).collect()}
    assert len(got) == len(rows) and sum(links) > 100
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], comp[i], comp[i] == i)
    assert embeddings.near_vectors(df.limit(0), 0.98).count() == 0


@pytest.mark.parametrize("kind", ["clustered", "isotropic"])
def test_cover_trees_count_their_distances(kind):
    """Nets halve, radii cover; on clustered vectors fewer distances are computed than there are pairs."""
    rng = np.random.default_rng(11)
    n = 1500
    centres = rng.normal(size=(40 if kind == "clustered" else n, 24))
    x = centres[np.arange(n) % len(centres)] + rng.normal(size=(n, 24)) * 0.08
    x[7::50] = x[3]  # a group of copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = embeddings.CoverTree(x)
    assert sorted(tree.rows) == list(range(n))
    for k in range(len(tree.center)):
        rows = tree.rows[tree.start[k] : tree.end[k]]
        far = np.sqrt(np.maximum(0, 2 - 2 * x[rows] @ x[tree.center[k]])).max()
        assert tree.center[k] in rows and far <= tree.radius[k] + 1e-6
        if tree.first[k] < tree.last[k]:
            inner = np.concatenate([np.arange(tree.start[c], tree.end[c]) for c in range(tree.first[k], tree.last[k])])
            assert inner.tolist() == list(range(tree.start[k], tree.end[k]))
    ids, ones = np.arange(n), np.ones(n, np.int64)
    packed = embeddings.CoverTree.unpack(tree.pack(), x)
    da, db, edges = embeddings.block_links(packed, packed, ones, ones, ids, ids, 0.98)
    hit = (x @ x.T >= 0.98) & ~np.eye(n, dtype=bool)
    assert (da + db == hit.sum(axis=1)).all()
    root = list(range(n))
    find = lambda v: v if root[v] == v else find(root[v])
    for u, v in [*edges, *zip(*np.nonzero(hit), strict=True)]:
        root[find(u)] = find(v)
    groups = len({find(v) for v in range(n)})
    root = list(range(n))
    for u, v in edges:
        assert hit[u, v] or u != v
        root[find(u)] = find(v)
    assert len({find(v) for v in range(n)}) == groups
    if kind == "clustered":
        assert tree.counted + packed.counted < n * (n - 1) // 2
    half = embeddings.CoverTree(x[:700]), embeddings.CoverTree(x[700:])
    da, db, _ = embeddings.block_links(*half, ones[:700], ones[700:], ids[:700], ids[700:], 0.98)
    assert (da == hit[:700, 700:].sum(axis=1)).all() and (db == hit[:700, 700:].sum(axis=0)).all()


def test_query_op10(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").orderBy("vec_id").collect()]
    links, comp = slow_vectors(rows, 0.98)
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op10_embeddings(spark, DATA).collect()}
    assert got == {r[0]: (links[i], rows[comp[i]][0]) for i, r in enumerate(rows)}


# ------------------------------------------------------------ 1


def slow_search(docs, query, k=10):
    words = {i: words_of(t) for i, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / max(1, len(docs))
    df = collections.Counter(w for x in words.values() for w in set(x))
    out = []
    q = collections.Counter(words_of(query))
    for i, w in words.items():
        tf, s = collections.Counter(w), 0.0
        for t, c in q.items():
            if t in tf:
                s += c * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean))
        if s > 0:
            out.append((-s, i))
    return sorted(out)[:k]


@pytest.mark.parametrize("shard_rows", [8192, 30])
def test_search_is_exact(spark, shard_rows):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(9001, None, "x"), (9002, "", "x"), (9003, "tie tie", "x"), (9004, "tie tie", "x"), (9005, LONG, "x")], docs.schema))
    asked = spark.createDataFrame([(1, "tie"), (2, "nowhere-at-all"), (3, None), (4, "The of AND wort"), (5, docs.first().text)], "query_id long, text string")
    index, n, _ = search.build_index(docs, shard_rows=shard_rows)
    got = collections.defaultdict(list)
    for r in search.bm25_search(index, n, asked).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    for r in asked.collect():
        want = slow_search(pairs, r.text)
        assert [d for d, _ in got[r.query_id]] == [i for _, i in want]
        assert np.allclose([s for _, s in got[r.query_id]], [-s for s, _ in want])
    assert search.bm25_search(index, n, asked.limit(0)).count() == 0
    empty, n, _ = search.build_index(docs.limit(0))
    assert search.bm25_search(empty, n, asked).count() == 0


def test_search_of_very_frequent_words(spark):
    docs = [(1, "wort " * 70_000 + "mehr " * 70_000), (2, "wort " * 65_535 + "mehr " * 74_465), (3, "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index, n, _ = search.build_index(df)
    got = search.bm25_search(index, n, spark.createDataFrame([(1, "wort")], "query_id long, text string")).orderBy("rank").collect()
    want = slow_search(docs, "wort")
    assert [r.doc_id for r in got] == [i for _, i in want]
    assert np.allclose([r.score for r in got], [-s for s, _ in want], rtol=1e-9, atol=0)


def test_search_deals_null_and_repeated_ids(spark):
    some = spark.range(70_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.concat(F.lit("all w"), F.col("id") % 5000).alias("text"))
    index, n, _ = search.build_index(some)
    assert max(len(r.ids) for r in index.select("ids").collect()) < 2 * search.SHARD_ROWS
    # one shard of more than 65,536 rows: no row number wraps
    whole, n, _ = search.build_index(spark.range(66_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text")), shard_rows=100_000)
    asked = spark.createDataFrame([(1, "w65900"), (2, "w3")], "query_id long, text string")
    assert {(r.query_id, r.doc_id) for r in search.bm25_search(whole, n, asked).collect()} == {(1, 65900), (2, 3)}


def test_query_op1(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = collections.defaultdict(list)
    for r in queries.op1_search(spark, DATA).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    asked = {i: t for i, t in docs if i % 100 == 0}
    assert set(got) == set(asked)
    for i, text in asked.items():
        want = slow_search(docs, text)
        assert [(k, d) for k, d, _ in got[i]] == [(k + 1, d) for k, (_, d) in enumerate(want)]
        assert np.allclose([s for _, _, s in got[i]], [-s for s, _ in want])


def test_search_queries_of_one_id_and_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "y z")], "doc_id string, text string")
    asked = spark.createDataFrame([(None, "x"), (None, "z"), (7, "y"), (7, "z")], "query_id int, text string")
    index, n, _ = search.build_index(docs, shard_rows=2)
    got = collections.Counter((r.query_id, r["rank"], r.doc_id) for r in search.bm25_search(index, n, asked).collect())
    assert got == collections.Counter([(None, 1, "a"), (None, 2, "b"), (None, 3, None), (None, 1, "c"), (7, 1, "a"), (7, 2, "b"), (7, 3, "c"), (7, 4, None), (7, 1, "c")])


def test_search_reads_few_postings():
    rng = np.random.default_rng(4)
    # some words stand everywhere, others are a topic's own
    texts = [[f"w{x}" for x in rng.integers(0, 60, 60)] + [f"t{i % 50}-{x}" for x in rng.integers(0, 400, int(rng.integers(5, 60)))] for i in range(3000)]
    terms, freqs = zip(*(np.unique(search.term_hashes(" ".join(t)), return_counts=True) for t in texts), strict=True)
    import pyarrow as pa

    lengths = [len(t) for t in texts]
    kinds = ["ids", "lengths", "names", "first", "doc", "tf", "kind", "total"]
    row = {k: v.to_pylist()[0] for k, v in zip(kinds, search.inverted(pa.array(range(3000)), list(terms), list(freqs), lengths), strict=True)}
    df = np.diff(np.frombuffer(row["first"], "<i4"))
    shard = search.Shard(pa.array(row["ids"]), row, float(np.mean(lengths)), np.frombuffer(row["names"], "<i8")[df > 3000 * search.COMMON_PART])
    whole = 0
    for i in range(0, 3000, 100):
        at = shard.find(terms[i])
        order = np.argsort(df[at], kind="stable")
        at, w = at[order], (freqs[i] * np.log1p((3000 - df[at] + 0.5) / (df[at] + 0.5)))[order]
        rows, scores = shard.top(at, w, int((df[at] <= 3000 * search.COMMON_PART).sum()), 10)
        full = np.zeros(3000)
        for a, x in zip(at, w, strict=True):
            s = slice(shard.first[a], shard.first[a + 1])
            full[shard.doc[s]] += x * shard.part[s]
        assert np.allclose(scores, np.sort(full)[::-1][:10]) and np.allclose(full[rows], scores)
        whole += int(df[at].sum())
    assert shard.read < 0.7 * whole
