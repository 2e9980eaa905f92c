import io
import math
import random
import tarfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from traitscan import queries
from traitscan.functions import arrays as A
from traitscan.functions import genotype as G
from traitscan.operators import annotate, interval, matrix, ordered, profile
from traitscan.operators.fdr import log10_fdr
from traitscan.plans.analysis import AnalysisConfig, ConfigError, run_analysis
from traitscan.sources import readers, writers
from traitscan.streaming import stateless


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_arrays(spark):
    lit = lambda xs: F.array(*map(F.lit, xs))
    x, y, runs = [17, 40, 3, 3, 99, 12], [12, 3, 50, 17], [4, 4, 7, 9, 9, 9, 15]
    r = one(spark, A.match(lit(x), lit(y)).alias("m"), A.run_index(lit(runs)).alias("d"), A.kronecker(lit([1.0, 2.0]), lit([3.0, 4.0])).alias("k"), A.shifted(lit([1, 2, 3]), 1).alias("s"))
    assert r.m == [y.index(v) if v in y else -1 for v in x]
    assert r.d == [sorted(set(runs)).index(v) for v in runs]
    assert r.k == [3, 4, 6, 8] and r.s == [3, 1, 2]
    keys = one(spark, A.natural_key(F.lit("a10"), ignore_case=True).alias("a"), A.natural_key(F.lit("A9"), ignore_case=True).alias("b"))
    assert keys.b < keys.a


def test_text_functions(spark):
    r = one(
        spark,
        A.half_up(F.lit(-2.5)).alias("h"), A.last_index_of(F.lit("abcabc"), "bc").alias("l"), A.last_index_of(F.lit("abc"), "x").alias("n"), A.index_of(F.lit("abc"), "c").alias("i"),
        A.replace_first(F.lit("a1b2"), "[0-9]", "_").alias("r"), A.trim_all(F.lit("\t a \n")).alias("t"), A.split_overlap(F.lit("a;b;;"), F.lit("c;;b"), ";").alias("o"), A.position(F.lit("1e6")).alias("p"),
        (A.natural_key(F.lit("x10")) > A.natural_key(F.lit("x9"))).alias("k"), A.full_match(F.lit("abc"), "ab").alias("f"), A.num(F.lit("x")).alias("z"),
    )
    assert (r.h, r.l, r.n, r.i, r.r, r.t, r.o, r.p, r.k, r.f, r.z) == (-2, 4, -1, 2, "a_b2", "a", True, 1000000, True, False, None)


def test_intervals(spark):
    spans = [("1", chr(97 + k), 7 * k % 23, 7 * k % 23 + k) for k in range(14)] + [("1", "whole", 0, 10**9), ("1", "bad", 9, 2)]
    frame = spark.createDataFrame(spans, "chr string, id string, start long, end long")
    points = spark.createDataFrame([("1", p) for p in range(0, 30, 4)] + [("2", 6), ("1", None), (None, 6)], "chr string, pos long")
    got = sorted((r.pos, r.id) for r in interval.stab_join(points, frame, 5).collect())
    assert got == sorted((p, n) for p in range(0, 30, 4) for _, n, s, e in spans if s <= p <= e)
    sets = {r.pos: r.id for r in interval.stab_payloads(points, frame, 5, "id").collect()}
    assert sets == {p: sorted(n for q, n in got if q == p) for p, _ in got}


def test_payloads_join_distinct_places_and_intervals(spark, monkeypatch):
    joined, plain = [], interval._stabs
    monkeypatch.setattr(interval, "_stabs", lambda *a: joined.append(plain(*a)) or joined[-1])
    points = spark.range(400).select(F.lit("1").alias("chr"), F.col("id"), (F.col("id") % 4).alias("pos"))
    spans = spark.range(400).select(F.lit("1").alias("chr"), (F.col("id") % 3).cast("string").alias("p"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    got = {r.id: r.p for r in interval.stab_payloads(points, spans, 5, "p").collect()}
    assert got == {k: ["0", "1", "2"] for k in range(400) if k % 4 < 2}
    assert joined[0].count() == 2 * 3
    two = spark.createDataFrame([("1", 7, 0), ("1", 7, 9), ("1", 7, 9), ("2", 8, 5)], "chr string, id long, pos long")
    more = spans.union(spark.createDataFrame([("1", "x", 8, 9), ("2", None, 5, 5)], spans.schema))
    assert {(r.id, tuple(r.p)) for r in interval.stab_payloads(two, more, 5, "p", by=["id"]).collect()} == {(7, ("0", "1", "2", "x")), (8, ())}


def joined_rows(df):
    """Rows that the joins of the last stage of a collected frame made."""
    todo, n = [df._jdf.queryExecution().executedPlan().executedPlan()], 0
    while todo:
        node = todo.pop()
        n += node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0
        todo += [node.plan()] if node.nodeName().startswith("ResultQueryStage") else [node.children().apply(k) for k in range(node.children().size())]
    return n


def test_places_and_intervals_are_joined_as_groups(spark, monkeypatch):
    monkeypatch.setattr(interval, "GROUP_ROWS", 8, raising=False)
    points = spark.createDataFrame([("1", k, 5) for k in range(8)] + [("1", 8, 90)] * 20 + [("1", 9, None), (None, 10, 5)], "chr string, id long, pos long")
    sites = spark.createDataFrame([("1", 100 + k, 5) for k in range(30)] + [("1", 200, 91), ("1", 201, 95), ("1", 202, None), (None, 203, 5)], "chr string, site long, site_pos long")
    spans = sites.select("chr", "site", (F.col("site_pos") - 2).alias("start"), (F.col("site_pos") + 2).alias("end"))
    want = sorted([(k, 100 + n) for k in range(8) for n in range(30)] + [(8, 200)] * 20)
    for out in (interval.stab_join(points, spans, 7), interval.cis_window(points, sites, 2)):
        got = [(r.id, r.site) for r in out.collect()]
        assert sorted(got) == want and joined_rows(out) == 4 + 3
        assert sum(x[1] != y[1] for x, y in zip(got, got[1:])) == 30  # the rows of an interval come in one run
    assert {(r.site, r.distance) for r in interval.cis_window(points, sites, 2).where("pos = 90").collect()} == {(200, -1)}


def test_overlaps_are_joined_as_groups(spark, monkeypatch):
    monkeypatch.setattr(interval, "GROUP_ROWS", 8, raising=False)
    a = spark.createDataFrame([("1", k, 5, 6) for k in range(8)] + [("1", 8, 90, 95)] * 2 + [("1", 9, 7, 5), (None, 10, 5, 6)], "chr string, id long, a_start long, a_end long")
    b = spark.createDataFrame([("1", 100 + k, 6, 9) for k in range(30)] + [("1", 200, 80, 90), ("1", 201, 96, 97), ("1", 202, 6, None)], "chr string, site long, b_start long, b_end long")
    pairs = interval.overlap_join(a, b, 7)
    got = [(r.id, r.site) for r in pairs.collect()]
    assert sorted(got) == sorted([(k, 100 + n) for k in range(8) for n in range(30)] + [(8, 200)] * 2)
    assert joined_rows(pairs) == 4 + 1
    assert sum(x[1] != y[1] for x, y in zip(got, got[1:])) == 30


@pytest.mark.parametrize("span", [0, 1, 6, 300])
def test_totals_over_intervals(spark, span):
    rng = random.Random(span)
    points = [(str(k % 2), rng.randint(-span, span)) for k in range(60)] + [(None, 0), ("0", None)]
    spans = [(str(k % 3), s, s + rng.choice([0, 1, 5, 40, 10**9]), k) for k in range(80) for s in [rng.randint(-span - 9, span + 9)]] + [("0", -(10**12), 10**12, None), ("0", 3, 2, 7), (None, 0, 0, 7), ("1", None, 0, 7)]
    totals = {"n": ("sum", F.lit(1)), "least": ("min", F.col("v")), "most": ("max", F.col("v")), "all": ("sum", F.col("v"))}
    got = interval.stab_totals(spark.createDataFrame(points, "chr string, pos long"), spark.createDataFrame(spans, "chr string, start long, end long, v long"), totals, ["chr"])
    held = {(c, p): [v for d, s, e, v in spans if d == c and None not in (s, p) and s <= p <= e] for c, p in points if c}
    some = {k: [x for x in v if x is not None] for k, v in held.items()}
    assert sorted(map(tuple, got.collect())) == sorted((*k, len(v), min(some[k], default=None), max(some[k], default=None), sum(some[k]) if some[k] else None) for k, v in held.items() if v)


def test_lengths_take_no_pairs_and_no_missing_keys(spark, tmp_path):
    for name, key in (("orders", "o_custkey"), ("lineitem", "l_partkey")):
        rows = spark.read.parquet(f"{DATA}/{name}.parquet")
        rows.withColumn(key, F.when(F.col(key) % 2 == 0, F.col(key))).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = queries.QUERIES["interval_lengths"](spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(queries.ORACLES["interval_lengths"]).fetchall())


def test_long_cis_keeps_repeated_points(spark):
    points = spark.createDataFrame([("1", 100), ("1", 100), ("9", 1), ("1", None)], "chr string, pos long")
    sites = spark.createDataFrame([("1", 100), ("1", 5000), ("1", 5000)], "chr string, site_pos long")
    assert sorted((str(r.pos), r.n_long_cis) for r in interval.long_cis_counts(points, sites, 50).collect()) == [("1", 0), ("100", 2), ("100", 2), ("None", 0)]
    many = [(str(k % 2), k * k % 211) for k in range(90)]
    far = interval.long_cis_counts(spark.createDataFrame(many, "chr string, pos long"), spark.createDataFrame(many[::3], "chr string, site_pos long"), 20)
    want = sorted((c, p, sum(d == c and abs(q - p) > 20 for d, q in many[::3])) for c, p in many)
    assert sorted((r.chr, r.pos, r.n_long_cis) for r in far.collect()) == want


def test_analysis_of_an_archive_with_alleles(spark, tmp_path):
    body = {"a.tped": "X rs1 0 100 A A A C C C A A A C\nMT rs2 0 200 T T T T G G T G G G\n", "a.tfam": "".join(f"f s{i} 0 0 1 -9\n" for i in range(5))}
    with tarfile.open(tmp_path / "g.tar.bz2", "w:bz2") as tar:
        for name, text in body.items():
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "y.csv").write_text("gene,s1,s2,s3,s4,s5\ng1,0.1,1.2,2.1,0.2,0.9\n")
    (tmp_path / "d.tped").write_text("1 rs1 0 100 0 1 2 0 1\n1 rs2 0 200 0 0 2 1 2\n")
    run = lambda g, more="": {(r.x_id, r.y_id): (round(r.rsq, 9), round(r.fx, 9)) for r in run_analysis(spark, AnalysisConfig.from_ini(f"genotype_file={g}\nexpression_file=y.csv\nthreshold=none\n{more}", str(tmp_path))).collect()}
    got = run("g.tar.bz2", "family_file=g.tar.bz2")
    assert got.keys() == {("rs1", "g1"), ("rs2", "g1")} and got[("rs1", "g1")] == run("d.tped")[("rs1", "g1")]
    tped, fam = readers.read_plink(spark, [str(tmp_path / "g.tar.bz2")])
    assert sorted(r.chrom for r in tped.collect()) == ["MT", "X"] and fam.count() == 5
    for key in ("pedigree_file=p", "covariate_random=age"):
        with pytest.raises(ConfigError, match="not supported"):
            run("d.tped", key)


def test_subjects_are_matched_by_name(spark, tmp_path):
    rng = np.random.default_rng(6)
    ids = [f"s{i}" for i in range(12)]
    x, y, age = rng.integers(0, 3, 12), rng.normal(size=12), rng.normal(size=12)
    (tmp_path / "g.tped").write_text("1 rs1 0 100 " + " ".join(map(str, x)) + "\n")
    (tmp_path / "g.tfam").write_text("".join(f"f {i} 0 0 1 -9\n" for i in ids))
    runs = []
    for order in (range(12), rng.permutation(12), rng.permutation(12)):
        (tmp_path / "y.csv").write_text("gene," + ",".join(ids[k] for k in order) + "\ng1," + ",".join(f"{y[k]:.9f}" for k in order) + "\n")
        (tmp_path / "c.csv").write_text("id,age\n" + "".join(f"{ids[k]},{age[k]:.9f}\n" for k in reversed(order)))
        ini = "genotype_file=g.tped\nfamily_file=g.tfam\nexpression_file=y.csv\ncovariate_file=c.csv\ncovariate_fixed=age\nthreshold=none\n"
        runs.append([(r.rsq, r.fx) for r in run_analysis(spark, AnalysisConfig.from_ini(ini, str(tmp_path))).collect()])
    d = np.column_stack([np.ones(12), age, x])
    assert runs[0][0][1] == pytest.approx(np.linalg.lstsq(d, y, rcond=None)[0][2], rel=1e-6)
    assert all(r[0] == pytest.approx(runs[0][0]) for r in runs)


def test_bound_matrices(spark):
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, values array<double>")
    assert [r["values"] for r in matrix.bind_columns(a, a).orderBy("id").collect()] == [[1, 1], [2, 2]]
    assert matrix.bind_rows(a, a).count() == 4
    with pytest.raises(Exception, match="row of 2 values"):
        matrix.bind_rows(a, matrix.bind_columns(a, a)).collect()


def test_rows_are_numbered_with_any_columns(spark, monkeypatch):
    from traitscan import tables

    monkeypatch.setattr(tables, "RANGE_ROWS", 300)
    rows = spark.range(2000).select((F.col("id") * 7919 % 40).alias("k"), F.col("id").alias("a"), F.lit("x").alias("b"))
    got = annotate.split_every(rows, 100, ["k"]).select("row_no", "file_no", "k", "a", "b").orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(2000)) and [r.k for r in got] == sorted(r.k for r in got) and len({r.a for r in got}) == 2000


def test_fdr_of_equal_values(spark, monkeypatch):
    import traitscan.operators.fdr as f

    monkeypatch.setattr(f, "RANGE_ROWS", 50)
    got = log10_fdr(spark.range(400).select("id", F.lit(-2.0).alias("log10p"))).orderBy("rank").collect()
    c = [0.0 if k == 0 else min(0.0, -2 + 2.6020599913279625 - math.log10(k)) for k in range(400)]
    assert [r.id for r in got] == list(range(400))
    assert [r.log10fdr for r in got] == pytest.approx([min(c[k:]) for k in range(400)])


def test_fdr_over_ranges(spark, monkeypatch):
    import traitscan.operators.fdr as f

    rows = [(i, -((i * 37) % 101) / 10) for i in range(300)]
    df = spark.createDataFrame([*rows, (999, None)], "id long, log10p double")
    whole = {r.id: (r["rank"], r.log10fdr) for r in log10_fdr(df).collect()}
    monkeypatch.setattr(f, "RANGE_ROWS", 40)
    parts = {r.id: (r["rank"], r.log10fdr) for r in log10_fdr(df).collect()}
    assert whole == parts and len(whole) == 300
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    c = [0.0 if k == 0 else min(0.0, p + math.log10(300) - math.log10(k)) for k, (_, p) in enumerate(order)]
    for k in range(298, -1, -1):
        c[k] = min(c[k], c[k + 1])
    assert [whole[i][1] for i, _ in order] == pytest.approx(c)


def test_genotypes(spark):
    r = one(spark, G.canonical(F.lit("CA")).alias("a"), G.canonical(F.lit("0T")).alias("b"), G.genotype(G.decode_allele(F.lit("T")), G.decode_allele(F.lit("-"))).alias("c"))
    assert (r.a, r.b, r.c) == ("AC", "T0", None)
    rows = spark.createDataFrame([(1, ["AC", "AA", "00", "CC", "AG"]), (2, ["00"]), (3, ["TT", "TT"])], "id long, symbols array<string>")
    got = {r.id: r for r in profile.recode_additive(rows).collect()}
    assert got[1].major == "A" and got[1].minor == "G" and got[1].codes == [None, 0, None, None, 1]
    assert got[2].major is None and got[2].maf is None and got[2].n_missing == 1
    assert (got[3].major, got[3].minor, got[3].maf) == ("T", "A", 0)


def test_last_duplicate_and_annotation(spark):
    t = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), (None, 3, "x")], "key string, o int, v string")
    u = annotate.last_per_key(t, "key", ["o"])
    main = spark.createDataFrame([("k",), ("z",), (None,)], "id string")
    got = annotate.annotate(main, {"S": (u.select("key", "v"), "key", "id")}).collect()
    assert got[0].__fields__ == ["S.v", "id"]
    assert sorted((str(r.id), r["S.v"]) for r in got) == [("None", None), ("k", "new"), ("z", None)]
    with pytest.raises(Exception, match="nope"):
        annotate.project(main, ["nope"]).collect()


def test_parents_and_peaks(spark):
    people = spark.createDataFrame([("f", "a", "0", "0", "M"), ("f", "b", "0", "0", "F"), ("f", "c", "a", "b", "F")], "family_id string, subject_id string, father_id string, mother_id string, sex string")
    child = annotate.resolve_parents(people).where("subject_id = 'c'").first()
    assert (child.father_sex, child.mother_sex) == ("M", "F")
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([0, 5, 1, 4, 0, 9, 8, 8.5, 0])], "s string, i int, v double")
    assert sorted(r.i for r in ordered.find_peaks(df, "v", "i", "s", 3).collect()) == [1, 5]
    direct = ordered.find_peaks(df, "v", "i", "s", 0)
    assert sorted(r.i for r in direct.collect()) == [1, 3, 5, 7]
    assert "InPandas" not in direct._jdf.queryExecution().toString()
    assert "peaks-" in ordered.find_peaks(df, "v", "i", "s", 3)._jdf.queryExecution().toString()  # the table of the last round
    prod = ordered.running_product(df.where("i in (1, 3, 4, 5)"), "v", ["s"], ["i"]).orderBy("i").collect()
    assert [round(r.cum_prod, 6) for r in prod] == [5, 20, 0, 0]


def test_sources(spark, tmp_path):
    (tmp_path / "g.tped").write_text("# c\nchrom id m bp x\n1 rs1 0 100 A A A C 0 0\n2 rs2 0 200 T T ? T C T\n")
    got = readers.tped_symbols(readers.read_tped(spark, str(tmp_path / "g.tped"))).orderBy("id").collect()
    assert [r.symbols for r in got] == [["AA", "AC", "00"], ["TT", "0T", "CT"]] and got[1].pos == 200
    (tmp_path / "f.tfam").write_text("fam a 0 0 1 -9\nfam b 0 0 2 -9\n")
    assert [r.sex for r in readers.read_fam(spark, str(tmp_path / "f.tfam")).orderBy("subject_id").collect()] == ["M", "F"]
    (tmp_path / "twice.fam").write_text("fam a 0 0 1 -9\nfam a 0 0 2 -9\n")
    with pytest.raises(ValueError, match="2 times"):
        readers.read_fam(spark, str(tmp_path / "twice.fam"))
    with tarfile.open(tmp_path / "x.tar.bz2", "w:bz2") as tar:
        body = b"1 rs1 0 100 A A\n"
        info = tarfile.TarInfo("d/a.tped")
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body))
    assert [tuple(r) for r in readers.read_tar(spark, str(tmp_path / "x.tar.bz2")).collect()] == [("d/a.tped", "1 rs1 0 100 A A")]
    (tmp_path / "m.bin").write_bytes(writers.binary_matrix(["r1", "r2"], ["a", "b"], [[1.0, 2.0], [3.0, 4.0]]))
    assert {r.id: r["values"] for r in readers.read_binary_matrix(spark, str(tmp_path / "m.bin")).collect()} == {"r1": [1, 2], "r2": [3, 4]}
    assert readers.read_ini("A=1\n# c\nb = x y\nstop\nc=2") == {"a": "1", "b": "x y"}
    assert readers.read_ini("[S]\nk=v\n; c", sections=True) == {"S": {"k": "v"}}
    (tmp_path / "ann.csv").write_text("key,v,w\na,1,x\na,2,y\nb,3,z\n")
    ann = readers.annotation_table(spark, str(tmp_path / "ann.csv"), "key", ["v", "n"], {"v": "value"}, rules={"n": "cast(v as int) * 2"})
    assert sorted(tuple(r) for r in ann.collect()) == [("a", "2", 4), ("b", "3", 6)]
    lines = writers.encoded_lines(spark.createDataFrame([(1, "7", 5, [0, None, 2])], "chrom int, id string, pos int, codes array<int>")).collect()
    assert lines[0].value == "1 ss7 0 5 0 - 2"


def test_analysis_end_to_end(spark, tmp_path):
    (tmp_path / "x.tped").write_text("1 rs1 0 100 0 1 2 1 0 2 1\n1 rs2 0 200 1 1 0 2 2 0 1\n")
    (tmp_path / "y.csv").write_text("gene,s1,s2,s3,s4,s5,s6,s7\ng1,0.1,1.2,2.1,0.9,0.2,1.8,1.1\ng2,1,,2,3,4,5,6\n")
    (tmp_path / "c.csv").write_text("sample,sex,age\n" + "".join(f"s{i},{'MF'[i % 2]},{20 + i * i}\n" for i in range(1, 8)))
    ini = "genotype_file=x.tped\nexpression_file=y.csv\ncovariate_file=c.csv\ncovariate_fixed=age\ncovariate_factor=sex\nthreshold=none\nrsq_only=true\noutput_file=out\n"
    got = run_analysis(spark, AnalysisConfig.from_ini(ini, str(tmp_path))).collect()
    assert {(r.x_id, r.y_id) for r in got} == {("rs1", "g1"), ("rs2", "g1")}  # g2 has a blank
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == ["Rs_ID", "ProbesetID", "RSq", "Dir"] and back.count() == 2
    with pytest.raises(ConfigError, match="unknown covariates"):
        run_analysis(spark, AnalysisConfig.from_ini(ini.replace("=age", "=height"), str(tmp_path)))
    with pytest.raises(ConfigError, match="threshold"):
        AnalysisConfig.from_ini("threshold=maybe 3")
    with pytest.raises(ConfigError, match="missing"):
        run_analysis(spark, AnalysisConfig())


def test_ragged_matrix_is_an_error(spark, tmp_path):
    (tmp_path / "y.csv").write_text("gene,s1,s2\ng1,1,2\ng2,1\n")
    with pytest.raises(Exception, match="1 vs 2"):
        readers.matrix_table(spark, str(tmp_path / "y.csv")).collect()


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, 5.0), (2, 50.0)], "id int, v double").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, v double").parquet(str(tmp_path / "in"))
    names = spark.createDataFrame([(2, "two")], "k int, name string")
    out = stateless.annotate_stream(stateless.filter_stream(stream, "v > 10"), names, "k", "id")
    q = out.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("hits").collect()] == [(2, 50.0, "two")]


def test_split_and_merge(spark, tmp_path):
    df = spark.range(25).select(F.col("id"), (-F.col("id")).cast("string").alias("p"))
    got = annotate.split_every(df, 10, ["id"]).groupBy("file_no").count().orderBy("file_no").collect()
    assert [tuple(r) for r in got] == [(0, 10), (1, 10), (2, 5)]
    assert [r.id for r in annotate.merge_sorted([df.where("id < 3"), df.where("id >= 23")], "p").collect()] == [24, 23, 2, 1, 0]
    writers.write_split(df.coalesce(1), str(tmp_path / "s"), 10)
    assert len(list((tmp_path / "s").glob("*.csv"))) == 3


def test_whole_tables_take_every_row(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    assert queries._sites(spark, DATA).count() == queries.QUERIES["match_positions"](spark, DATA).count() == lines.count()
    keys = lambda df, a, b: {tuple(r) for r in df.select(a, b).collect()}
    small = keys(lines.where("l_quantity < 49"), "l_orderkey", "l_linenumber")
    for name in ("interval_stab", "cis_window", "interval_overlap"):
        assert keys(queries.QUERIES[name](spark, DATA), "site", "line") & small
