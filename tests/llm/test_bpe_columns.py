"""The encoder of operators 6, 7 and 13 on many texts at once: columns of words, merged batches."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from traitscan.llm import bpe, queries

SAFE = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA0, 0x130), *range(0x131, 0x180)]]
PARTS = [*SAFE, "'s", "'ll", "'re", "'d", "th", "er", "the ", "<|endoftext|>", "日本", "é́", "Σ", "\x1c", "\x85", "'", "'", " ", "  ", "jq", "xz", "\0"]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(queries.word_bpe_path())


def check(b, tok, texts):
    for text, ids in zip(texts, b.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text or "", add_special_tokens=False).ids, text


def test_columns_equal_the_library(tok, monkeypatch):
    monkeypatch.setattr(bpe, "BULK_CHARS", 1)
    b = bpe.WordBpe(queries.word_bpe_path())
    assert b.columns
    check(b, tok, [x + c + y for c in SAFE for x, y in (("", ""), ("a", "b"), ("1", ""), ("'", "'s"), (".", " "), ("É", c.upper()))])
    check(b, tok, [chr(c) + "x" for c in range(1, 0x3100)])
    rng = random.Random(3)
    texts = [None, "", " ", *("".join(rng.choice(PARTS) for _ in range(rng.choice([1, 5, 30, 200]))) for _ in range(600))]
    check(b, tok, texts)
    monkeypatch.setattr(bpe, "WINDOW_CHARS", 50)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    check(b, tok, [*texts, "xñ" * 3000, "word " * 900])


def test_signs_make_no_new_words():
    """A word with a sign behind it is looked up and learned as the word (before: once for each sign)."""
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshr") for _ in range(9)) for _ in range(500)]
    signs = list(".,;:!?)]") + ["..."]
    b = bpe.WordBpe(queries.word_bpe_path())
    b.encode([" ".join(w + s for w in words) for s in signs])
    assert len(b.cache) <= len(words) + len(signs) + 1


def test_merged_batches():
    """Small batches are encoded together (before: one by one), large ones as they are; no row is lost."""
    rows = [pa.RecordBatch.from_pydict({"id": list(range(i * 10, i * 10 + 10)), "text": ["x" * (1 << 15 if i == 7 else 100)] * 10}) for i in range(20)]
    got = list(bpe.merged(iter([*rows, rows[0].slice(0, 0)]), size=1 << 12))
    assert len(got) < 8 and sum((g.column(0).to_pylist() for g in got), []) == list(range(200))
    assert list(bpe.merged(iter([]))) == []
