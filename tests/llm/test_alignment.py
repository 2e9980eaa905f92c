"""Operator 12 against both libraries on whole texts and a plain merge."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.conftest import DATA
from traitscan.llm import alignment, queries
from traitscan.llm.bpe import byte_letters

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
TOK = Tokenizer.from_file(A)
TOK.encode_special_tokens = True
SP = SentencePieceProcessor(model_file=B)
BYTE = {c: i for i, c in enumerate(byte_letters())}
AWKWARD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "a \n b", "a\n  b\n\n", "x\ty \t z", "▁x", "foo▁bar baz", "é́ ñ Ñandú  12,5 …—don't'stop \x1cq İx Σας", "日本語 テスト x 漢字", "<|endoftext|> <s> </s> <0x41> <unk>",
    "a\xa0 b　 c\x85 d  e", "\x1f x \x0b y\0z", "😀😀 👩‍👩‍👧 x", "ﬁ ① Ａ", "  lead and trail   ", "same text here", "same text here", "x" * 3000, "long " * 40_000, "q" * 9000 + " w",
]


def brute(texts):
    rows, held = [], []
    for t in texts:
        a, b, groups = [], [], []
        if t:
            raw = (" " + t).encode()
            a = TOK.encode(" " + t, add_special_tokens=False).ids
            b = SP.encode(t)
            xs = [bytes(BYTE[c] for c in TOK.id_to_token(i)) for i in a]
            ys = [bytes([int(p[1:-1], 16)]) if SP.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [SP.id_to_piece(i)]]
            if b"".join(xs) != raw or b"".join(ys) != raw:
                a, b = [], []
            else:
                ea, eb = np.cumsum([len(x) for x in xs]).tolist(), np.cumsum([len(y) for y in ys]).tolist()
                i = j = 0
                for c in sorted(set(ea) & set(eb)):
                    p, q = ea.index(c, i) + 1, eb.index(c, j) + 1
                    groups.append((a[i:p], b[j:q]))
                    i, j = p, q
        links = collections.Counter((x, y) for g in groups for x in g[0] for y in g[1])
        rows.append((a, b, groups, links))
        held += links.keys()
    docs = collections.Counter(held)
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for a, b, groups, links in rows:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), sum(links.values()), sum(k for p, k in links.items() if docs[p] == most[p[0]]), sum(k * docs[p] for p, k in links.items()), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_vocabularies_part_at_blanks():
    assert alignment.Pair(A, B).parted


def test_units_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_UNITS", 50)
    monkeypatch.setattr(alignment, "LANE_UNITS", 3)
    pair = alignment.Pair(A, B)
    rng = random.Random(4)
    pieces = ["ab", " ", " ", "\n", "\t", "é", "don't", "x1", "...", "Σ", "日本", "<|endoftext|>", "\xa0", "\x1c", "　", "▁", "'ll", "2024", "😀"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.choice([1, 3, 30, 200]))) for _ in range(150)]
    for at in range(0, 150, 10):
        some = texts[at : at + 10]
        got = alignment.align_batch(pair, some)
        want = brute(some)
        assert list(zip(got["n_a"], got["n_b"], got["n_groups"], got["n_links"], got["groups_sha256"], strict=True)) == [(w[0], w[1], w[2], w[3], w[6]) for w in want], some


def test_large_groups(monkeypatch):
    ids_a, ids_b = np.array([1, 2, 1, 3, 1]), np.array([5, 6, 5, 5])
    spans = (np.array([0, 4]), np.array([4, 5]), np.array([0, 3]), np.array([3, 4]))
    want = alignment.link_pairs(ids_a, ids_b, *spans, np.array([0, 0]), 10, 10)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 2)
    got = alignment.link_pairs(ids_a, ids_b, *spans, np.array([0, 0]), 10, 10)
    assert [x.tolist() for x in got] == [x.tolist() for x in want]
    assert dict(zip(zip(want[1].tolist(), want[2].tolist(), strict=True), want[3].tolist(), strict=True)) == {(1, 5): 5, (1, 6): 2, (2, 5): 2, (2, 6): 1, (3, 5): 2, (3, 6): 1}


@pytest.mark.parametrize("hot", [200_000, 3])
def test_awkward_documents(spark, hot):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(AWKWARD)], "doc_id long, text string, k string").repartition(3)
    got = {r.doc_id: r for r in alignment.cross_token_links(docs, A, B, hot_pairs=hot).collect()}
    for i, w in enumerate(brute(AWKWARD)):
        assert tuple(got[i][c] for c in COLS) == w, repr(AWKWARD[i])[:60]
    odd = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(tuple(r[c] for c in COLS) for r in alignment.cross_token_links(odd, A, B).collect()) == sorted(brute(AWKWARD))
    assert alignment.cross_token_links(docs.limit(0), A, B).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op12_alignment(spark, DATA).collect()}
    want = brute([r.text for r in docs])
    assert len(got) == len(docs)
    for d, w in zip(docs, want, strict=True):
        assert tuple(got[d.doc_id][c] for c in COLS) == w


class Counted:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, tok):
        self.tok, self.texts = tok, []

    def encode_batch_fast(self, texts, **kw):
        self.texts += texts
        return self.tok.encode_batch_fast(texts, **kw)


def columns(got):
    return list(zip(got["n_a"].tolist(), got["n_b"].tolist(), got["n_groups"].tolist(), got["n_links"].tolist(), got["groups_sha256"], strict=True))


def test_units_are_encoded_in_lanes_and_aligned_once(monkeypatch):
    pair = alignment.Pair(A, B)
    pair.a = Counted(pair.a)
    texts = [" ".join(f"word{i}ing, é{i}" for i in range(k, k + 256)) for k in (0, 128, 256)]
    want = [(w[0], w[1], w[2], w[3], w[6]) for w in brute(texts)]
    assert columns(alignment.align_batch(pair, texts)) == want
    assert len(pair.a.texts) == 512 // alignment.LANE_UNITS + 512  # units with other than ASCII characters alone
    monkeypatch.setattr(alignment, "lockstep", None)
    assert columns(alignment.align_batch(pair, texts[::-1])) == want[::-1]
    assert len(pair.a.texts) == 512 // alignment.LANE_UNITS + 512


def test_one_unit_of_a_lane_differs(monkeypatch):
    pair = alignment.Pair(A, B)
    pair.a = Counted(pair.a)
    texts = ["some words here", "x <0x41> a\x01b c\x02 here", None, "\x7f d", "a\0b", "here are some"]
    want = [(w[0], w[1], w[2], w[3], w[6]) for w in brute(texts)]
    assert columns(alignment.align_batch(pair, texts)) == want
    # B as a library that loses a sign: its unit counts as different, the others of its lane do not
    pair.known = alignment.Known.none()
    whole = pair._encode
    monkeypatch.setattr(pair, "_encode", lambda lanes: (lambda a, b: (a, [y[:-1] if "lost" in lane else y for lane, y in zip(lanes, b, strict=True)]))(*whole(lanes)))
    got = columns(alignment.align_batch(pair, [*texts, "some lost here", "lost"]))
    assert got == [*want, (0, 0, 0, 0, ""), (0, 0, 0, 0, "")]


def test_small_caches(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_BYTES", 100)
    pair = alignment.Pair(A, B)
    for k in range(0, 60, 3):
        texts = ["", f"one {k} two {k + 1}x three", "one two " * (k + 1) + "y" * 40 * k]
        assert columns(alignment.align_batch(pair, texts)) == [(w[0], w[1], w[2], w[3], w[6]) for w in brute(texts)]
        assert len(pair.known.names) < 20
