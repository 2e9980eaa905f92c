"""Operator 13: frames, checksums, offsets, shuffled reads, awkward rows, damage."""

import json
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from traitscan.llm import queries, records
from traitscan.llm.records import read_token_records, write_token_records

PATH = queries.word_bpe_path()
TOK = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array([*TOK.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def slow_crc32c(data):
    r = 0xFFFFFFFF
    for b in data:
        r ^= b
        for _ in range(8):
            r = r >> 1 ^ (records.CRC32C_POLYNOMIAL if r & 1 else 0)
    return r ^ 0xFFFFFFFF


def test_checksums():
    rng = random.Random(1)
    parts = [b"123456789", *(rng.randbytes(n) for n in (4, 5, 63, 64, 65, 127, 128, 1000, 4096, 9999))]
    got = records.Crc32c().each(parts)
    assert got[0] == 0xE3069283 and got.tolist() == [slow_crc32c(p) for p in parts]
    masked = int(records.masked_crc32c([b"123456789"])[0])
    unmasked = (masked - records.MASK_DELTA) & 0xFFFFFFFF
    assert (unmasked >> 17 | unmasked << 15) & 0xFFFFFFFF == 0xE3069283


def test_payloads_and_frames():
    wide = np.array([70000, 1], "<u4").tobytes()
    payloads = [records.payload_of("é", b""), records.payload_of(None, wide), records.payload_of("", np.array([1, 2], "<u4").tobytes())]
    assert [records.parse_payload(p) for p in payloads] == [("é", b""), (None, wide), ("", np.array([1, 2], "<u4").tobytes())]
    made = records.frames(payloads)
    starts = np.cumsum([0, *map(len, made)])
    assert records.unframe(b"".join(made), starts, "x") == payloads
    broken = bytearray(b"".join(made))
    broken[14] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        records.unframe(bytes(broken), starts, "x")


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_records(spark, DATA).collect()}
    assert set(got) == set(texts)
    before = 0
    for i in sorted(texts):
        ids = ids_of(texts[i])
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)


def test_awkward_rows_and_shuffled_reads(spark, tmp_path):
    rows = [(3, "c c"), (1, None), (2, ""), (None, "nobody"), (None, None), (3, "c c"), (3, "other"), (-5, "first " * 30_000), *((100 + i, f"text {i}") for i in range(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("ids", F.lit("clash"))
    path = str(tmp_path / "out")
    write_token_records(docs, path, PATH, shard_bytes=600)
    files = json.load(open(f"{path}/manifest.json"))["files"]
    assert len(files) > 2
    open(f"{path}/part-000000-left-by-a-lost-task.rec", "wb").write(b"never read")
    got = read_token_records(spark, path, records_per_task=20).collect()
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.key for r in in_order] == [None, None, "-5", "1", "2", "3", "3", "3", *map(str, range(100, 300))]
    before = 0
    for r in in_order:
        assert r.start == before and r.n_ids * 4 == len(r.ids)
        before += r.n_ids
    want = sorted((str(k) if k is not None else "", ids_of(t).tobytes()) for k, t in rows)
    assert sorted((r.key or "", bytes(r.ids)) for r in got) == want
    mixed = [(r.start, r.key) for r in read_token_records(spark, path, shuffle_seed=1, records_per_task=64).collect()]
    again = [(r.start, r.key) for r in read_token_records(spark, path, shuffle_seed=1, records_per_task=64).collect()]
    other = [(r.start, r.key) for r in read_token_records(spark, path, shuffle_seed=2, records_per_task=64).collect()]
    assert mixed == again != other and mixed != sorted(mixed) and sorted(mixed, key=lambda x: x[0]) == [(r.start, r.key) for r in in_order]


def test_empty_table_and_damage(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some text here") for i in range(20)], "doc_id long, text string")
    write_token_records(docs.limit(0), str(tmp_path / "none"), PATH)
    assert read_token_records(spark, str(tmp_path / "none")).count() == 0
    path = str(tmp_path / "some")
    write_token_records(docs, path, PATH)
    name = json.load(open(f"{path}/manifest.json"))["files"][0]["name"]
    raw = bytearray(open(f"{path}/{name}.rec", "rb").read())
    raw[len(raw) // 2] ^= 4
    open(f"{path}/{name}.rec", "wb").write(raw)
    with pytest.raises(PySparkException, match="checksum|length"):
        read_token_records(spark, path).collect()
    assert os.path.getsize(f"{path}/{name}.idx") % 16 == 0
