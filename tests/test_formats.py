"""Files that Python data sources read and write."""

import json
import os
import struct
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitscan.functions import arrays as A
from traitscan.operators.profile import cis_trans_summary
from traitscan.sources import formats, readers, writers


def test_matrix_files_in_parts(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(57, 5))
    ids = [f"é{i}" * (1 + i % 3) for i in range(57)]
    (tmp_path / "a.bin").write_bytes(writers.binary_matrix(ids, list("abcde"), x.tolist()))
    got = readers.read_binary_matrix(spark, str(tmp_path / "a.bin"), rows_per_task=10)
    assert got.rdd.getNumPartitions() == 6
    assert {r.id: r["values"] for r in got.collect()} == dict(zip(ids, x.tolist(), strict=True))
    bare = struct.pack(">8i", 2, 0, 3, 0, 0, 0, 0, 0) + np.arange(6, dtype=">f8").tobytes()
    (tmp_path / "b.bin").write_bytes(bare)
    assert {r.id: r["values"] for r in readers.read_binary_matrix(spark, str(tmp_path / "b.b*")).collect()} == {"0": [0, 1, 2], "1": [3, 4, 5]}
    (tmp_path / "c.bin").write_bytes(bare[:-1])
    with pytest.raises(Exception, match="size of 2 x 3"):
        readers.read_binary_matrix(spark, str(tmp_path / "c.bin")).collect()


def test_relative_paths_and_uris(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    rows = spark.createDataFrame([("a", [1.0, 2.0])], "id string, values array<double>")
    formats.write_matrix_files(rows, "m")
    for path in ("m", f"file:{tmp_path}/m", f"file://{tmp_path}/m", f"{tmp_path}/m/"):
        assert readers.read_binary_matrix(spark, path).collect() == [("a", [1.0, 2.0])]


def test_matrix_round_trip(spark, tmp_path, monkeypatch):
    rows = spark.range(1000).select("id", F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.when((F.col("id") + k) % 7 != 0, F.col("id") * k / 3)).alias("values")).repartition(4)
    path = str(tmp_path / "m")
    formats.write_matrix_files(rows, path, [f"c{k}" for k in range(20)])
    names = json.load(open(f"{path}/manifest.json"))
    assert len(names) == 4
    (tmp_path / "m" / "part-left-by-a-lost-task.bin").write_bytes(b"x")
    back = {r.id: r["values"] for r in readers.read_binary_matrix(spark, path, rows_per_task=100).collect()}
    assert len(back) == 1000
    for r in rows.collect():
        assert np.array_equal(back[str(r.id)], [np.nan if v is None else v for v in r["values"]], equal_nan=True)
    with pytest.raises(Exception, match="has 1 values, not 20"):
        formats.write_matrix_files(rows.withColumn("values", F.array(F.lit(1.0))), str(tmp_path / "n"), [f"c{k}" for k in range(20)])
    formats.write_matrix_files(rows.limit(0), str(tmp_path / "o"))
    assert readers.read_binary_matrix(spark, str(tmp_path / "o")).count() == 0


@pytest.mark.parametrize("kind", ["", ":gz", ":bz2"])
def test_archives_are_streamed(spark, tmp_path, kind):
    (tmp_path / "a.tped").write_text("".join(f"line {k}\n" for k in range(25_000)))
    (tmp_path / "b.TFAM").write_text("x\ny")
    (tmp_path / "c.txt").write_text("never\n")
    os.mkdir(tmp_path / "in")
    for n in range(2):
        with tarfile.open(tmp_path / "in" / f"{n}.tar{kind.replace(':', '.')}", f"w{kind}") as tar:
            for name in ("a.tped", "b.TFAM", "c.txt"):
                tar.add(tmp_path / name, name)
    got = readers.read_tar(spark, str(tmp_path / "in"))
    assert got.rdd.getNumPartitions() == 2
    assert {(r.name, r["count"]) for r in got.groupBy("name").count().collect()} == {("a.tped", 50_000), ("b.TFAM", 4)}
    assert readers.read_tar(spark, str(tmp_path / "in" / "0.*"), (".tfam",)).orderBy("value").collect() == [("b.TFAM", "x"), ("b.TFAM", "y")]


def test_files_of_exactly_n_rows(spark, tmp_path, monkeypatch):
    from traitscan import tables

    monkeypatch.setattr(tables, "RANGE_ROWS", 70)
    monkeypatch.setattr(writers, "RANGE_ROWS", 70)
    df = spark.range(1005).select(F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("k"), F.concat(F.lit('a,"'), "id").alias("text")).repartition(5)
    writers.write_numbered(df, str(tmp_path / "out"), 100, ["k", "text"], "x-")
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"x-{k}.csv" for k in range(11))
    want = sorted((r.k, r.text) for r in df.collect())
    for k in range(11):
        got = spark.read.csv(str(tmp_path / "out" / f"x-{k}.csv"), header=True, escape="\\").collect()
        assert [(int(r.k), r.text) for r in got] == want[100 * k : 100 * k + 100]
    (tmp_path / "lines.txt").write_text("head,er\n" + "".join(f' {k},"q" \n' for k in range(250)))
    writers.cut_lines(spark, str(tmp_path / "lines.txt"), str(tmp_path / "cut"), 100)
    assert [len(open(tmp_path / "cut" / f"part-{k}.csv").readlines()) for k in range(3)] == [101, 101, 51]
    assert "".join(open(tmp_path / "cut" / f"part-{k}.csv").read().split("\n", 1)[1] for k in range(3)) == "".join(f' {k},"q" \n' for k in range(250))


def test_distinct_by_class_without_expand(spark):
    rows = [(1, "a", True, 0.1), (1, "b", False, 0.1), (2, "a", True, 0.1), (2, "a", True, 0.1), (3, "c", None, 0.1), (None, "c", True, 0.1), (9, "z", True, 9.0)]
    df = spark.createDataFrame(rows, "marker int, feature string, is_cis boolean, p double")
    out = cis_trans_summary(df, "p", 0.5)
    assert {tuple(r) for r in out.collect()} == {(None, 1, 1, 1), ("true", 4, 2, 2), ("false", 1, 1, 1), ("all", 6, 3, 3)}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in cis_trans_summary(df.limit(0), "p", 0.5).collect()] == [("all", 0, 0, 0)]


def test_natural_order_by_collation(spark):
    names = ["x10", "X9", "é2", "E2", "e10", "x010", "a1b2", "A1b10"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(A.natural_order("n", "UNICODE_CI_AI"), "n").collect()]
    assert got == ["a1b2", "A1b10", "E2", "é2", "e10", "X9", "x010", "x10"]
    groups = df.groupBy(A.natural_order("n", "UNICODE_CI_AI").alias("k")).agg(F.sort_array(F.collect_list("n")).alias("n"))
    assert {tuple(r.n) for r in groups.collect() if len(r.n) > 1} == {("x010", "x10"), ("E2", "é2")}


def test_bits_and_long_running_sums(spark):
    r = spark.range(1).select(A.complement(F.lit(5)).alias("c"), A.shifted_bits(F.lit(-8), -1).alias("r"), A.shifted_bits(F.lit(-8), -1, unsigned=True).alias("u"), A.shifted_bits(F.lit(3), F.lit(4)).alias("l")).first()
    assert tuple(r) == (-6, -4, 2147483644, 48)
    import time

    spent = []
    for n in (1, 63, 64, 65, 5000, 300_000):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: (k % 10).cast("double")).alias("v")).cache()
        df.count()
        began = time.time()
        got = df.select(A.running_sum("v").alias("s")).first().s
        spent.append(time.time() - began)
        assert np.allclose(got, np.cumsum(np.arange(1, n + 1) % 10))
    assert spark.range(1).select(A.running_sum(F.array().cast("array<double>")).alias("s")).first().s == []
    assert spent[-1] < 60
