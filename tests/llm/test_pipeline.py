"""The pipeline as a whole against its stages done by brute force."""

import collections

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_operators import LONG, slow_components
from traitscan.llm import queries

TOK = Tokenizer.from_file(queries.word_bpe_path())


def slow_lines(rows):
    """(id, source, text) without the lines that 1 % of a source's different texts, and 3, hold."""
    pages, seen = collections.Counter(), collections.defaultdict(set)
    for source, text in {r[1:] for r in rows}:
        pages[source] += 1
        for line in (text or "").split("\n"):
            seen[source, line].add(text)
    bad = {k for k, v in seen.items() if k[1] and len(v) >= 3 and len(v) > 0.01 * pages[k[0]]}
    out = []
    for i, source, text in rows:
        new = None if text is None else "\n".join(x for x in text.split("\n") if (source, x) not in bad)
        if not (text or "").strip() or new.strip():
            out.append((i, source, new))
    return out


def slow_keep_one(rows):
    """One row of each near-duplicate group (five words, 0.8): that of the least id."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    roots, sizes = slow_components([r[2] for r in rows], 5, 80)
    return [r for k, r in enumerate(rows) if roots[k] == k or not sizes[k]]


def slow_tail(kept):
    """(id, tokens) of what the last three stages make of the language stage's rows."""
    return collections.Counter((i, len(TOK.encode(t or "", add_special_tokens=False).ids) + 1) for i, _, t in slow_keep_one(slow_lines(kept)))


def check_whole(pieces, want):
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == want
    windows, tokens = collections.defaultdict(list), collections.Counter()
    for r in pieces:
        windows[r.sequence_id].append((r.offset, r.offset + r.length))
        tokens[r.doc_id, r.doc_tokens] += r.length
    assert tokens == collections.Counter({k: k[1] * n for k, n in want.items()})
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def language_rows(spark, docs):
    kept = dict(corpus_pipeline.STAGES)["language"](spark, docs, DATA)
    assert kept.columns == docs.columns
    return [(r.doc_id, r.source, r.text) for r in kept.collect()]


def write(docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "packing"]


def test_run_on_the_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = language_rows(spark, docs)
    assert len(kept) > 0.8 * docs.count()
    check_whole(corpus_pipeline.run(spark, DATA).collect(), slow_tail(kept))


def test_run_with_awkward_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    first = docs.first()
    some = docs.limit(8).collect()
    odd = [(90001, "123 456 !!", "en", "src1", 10), (90002, None, "en", None, None), (90003, "", None, "src1", 0), (None, first.text + " tail", "en", None, 5), (None, "quite another text than the rest of them all", None, None, 5)]
    odd += [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in some for _ in range(3)]  # repeated rows
    odd += [(90010 + k, r.text, r.lang, "other", r.n_chars) for k, r in enumerate(some)]  # copies under other ids
    odd += [(90050, LONG, "en", "src2", len(LONG)), (some[0].doc_id, some[1].text + "\nand more of it", "en", "src3", 3)]  # a very long text, one id with two texts
    rows = docs.union(spark.createDataFrame(odd, docs.schema)).withColumns({"n_lines": F.lit(1), "score": F.lit("x"), "rule": F.lit(2), "nid": F.lit("y")}).repartition(3)
    folder = write(rows, tmp_path)
    kept = language_rows(spark, spark.read.parquet(f"{folder}/documents.parquet"))
    assert not {90001, 90002, 90003} & {r[0] for r in kept} and any(r[0] is None for r in kept)
    # equal ids: any of the copies of one group may stay, so ids and tokens are compared as a multiset
    check_whole(corpus_pipeline.run(spark, folder).collect(), slow_tail(kept))


def test_run_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert corpus_pipeline.run(spark, write(docs, tmp_path)).count() == 0
    odd = docs.withColumns({"n_lines": F.lit(1), "score": F.lit("x")})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, DATA).count() == 0


@pytest.mark.parametrize("k", range(3))
def test_stages_return_the_columns_of_documents(spark, k):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    out = corpus_pipeline.STAGES[k][1](spark, docs, DATA)
    assert out.columns == docs.columns and out.count() <= 20
