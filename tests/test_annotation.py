"""The sectioned annotation run, its errors, and intervals of any length."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from traitscan.operators import annotate, interval
from traitscan.plans import annotation

PROBES = "probe,seqname,symbol,extra\np1,chr1,AAA,x\np2,chr2, BBB ,y\np1,chr7,LAST,z\n,chr9,NOKEY,z\n"
SNPS = "marker\tpos\tchr\nrs1\t100\t7\nrs2\t250\t2\n"
PAIRS = "ProbesetID,Rs_ID,RSq\np1,rs1,0.9\np2,rs1,0.2\np3,rs2,0.7\np2,rs9,0.6\n"
INI = """
; comment
[Gene]
file = probes.csv
columns_kept = probe, seqname, symbol
columns_rename = Probe, Gene_Chr, Gene
Gene_Chr = substring(Gene_Chr, 4)

# another
[Snp]
file = snps.txt
file_format = tab

[Main]
input = pairs.csv
output = out
matching_rule = Gene.Probe == Main.ProbesetID, Main.Rs_ID == Snp.marker
Same = if(Gene_Chr = Snp.chr, 'y', 'n')
Main.RSq = cast(round(cast(Main.RSq as double) * 10) as int)
"""


@pytest.fixture
def folder(tmp_path):
    for name, text in (("probes.csv", PROBES), ("snps.txt", SNPS), ("pairs.csv", PAIRS), ("a.ini", INI)):
        (tmp_path / name).write_text(text)
    return tmp_path


def run(spark, folder, text):
    plan = annotation.parse_plan(text)
    return annotation.annotated(plan, lambda f, k: annotation.read_section_file(spark, f"{folder}/{f}", k))


def test_configuration_to_csv(spark, folder):
    got = annotation.run_annotation(spark, f"{folder}/a.ini")
    assert got.columns == ["Gene.Probe", "Gene.Gene_Chr", "Gene.Gene", "Snp.marker", "Snp.pos", "Snp.chr", "Main.ProbesetID", "Main.Rs_ID", "Main.RSq", "Same"]
    back = [tuple(r) for r in spark.read.csv(f"{folder}/out", header=True).collect()]
    none = lambda r: tuple(x or "" for x in r)
    assert sorted(map(none, back)) == sorted([
        ("p1", "7", "LAST", "rs1", "100", "7", "p1", "rs1", "9", "y"),
        ("p2", "2", "BBB", "rs1", "100", "7", "p2", "rs1", "2", "n"),
        ("", "", "", "rs2", "250", "2", "p3", "rs2", "7", "n"),
        ("p2", "2", "BBB", "", "", "", "p2", "rs9", "6", "n"),
    ])


def test_order_header_and_places_of_rules(spark, folder):
    got = run(spark, folder, INI + "column_order = Rs_ID, Same, Snp.pos, RSq, Gene\nnew_header = a, b, c, d, e\n")
    assert got.columns == list("abcde")
    assert {tuple(r) for r in got.collect()} == {("rs1", "y", "100", 9, "LAST"), ("rs1", "n", "100", 2, "BBB"), ("rs2", "n", "250", 7, None), ("rs9", "n", None, 6, "BBB")}


@pytest.mark.parametrize(("change", "says"), [
    (("Gene.Probe == Main.ProbesetID", "Gene.Probe = Main.ProbesetID"), "no =="),
    (("Gene.Probe ==", "Probe =="), "no Section.column"),
    (("Gene.Probe ==", "Nobody.Probe =="), "unknown section"),
    (("Main.Rs_ID == Snp.marker", "Gene.Gene == Main.Rs_ID"), "linked twice"),
    (("Main.Rs_ID == Snp.marker", "Gene.Gene == Snp.marker"), "does not link Main"),
    (("matching_rule", "rule"), "no matching_rule"),
    (("input = pairs.csv", "; none"), "no input"),
    (("[Main]", "[Other]"), "no section Main"),
    (("file = snps.txt", "; none"), "no file in section"),
    (("columns_rename = Probe, Gene_Chr, Gene", "columns_rename = Probe, Gene_Chr"), "keeps 3 columns"),
    (("columns_rename = Probe, Gene_Chr, Gene", "columns_rename = Probe, Gene, Gene"), "twice"),
    (("Main.Rs_ID ==", "Main.nothing =="), "Main has no column"),
    (("== Snp.marker", "== Snp.nothing"), "no key column"),
    (("output = out", "output = out\ncolumn_order = Gene, nothing"), "is not found"),
    (("output = out", "output = out\ncolumn_order = Gene, Gene"), "twice"),
    (("output = out", "output = out\ncolumn_order = Gene\nnew_header = a, b"), "1 names and new_header 2"),
    (("output = out", "output = out\nnew_header = a, b"), "2 names for 10"),
    (("columns_rename = Probe, Gene_Chr, Gene", "columns_rename = Probe, Gene_Chr, pos\nSnp_Pos = 1"), None),
])
def test_errors(spark, folder, change, says):
    text = INI.replace(*change)
    assert text != INI
    if says is None:
        with pytest.raises(ValueError, match="write Section.pos"):
            run(spark, folder, text + "column_order = pos\n")
        return
    with pytest.raises(ValueError, match=says):
        run(spark, folder, text)


def test_unknown_names_in_rules_and_ragged_rows(spark, folder):
    with pytest.raises(PySparkException):
        run(spark, folder, INI.replace("Snp.chr,", "Snp.nothing,"))
    (folder / "pairs.csv").write_text(PAIRS + "p1,rs1\n")
    with pytest.raises(Exception, match="pairs.csv|MALFORMED"):
        run(spark, folder, INI + "column_order = Gene\n").collect()


def test_in_file(spark, folder):
    df = spark.createDataFrame([("p1",), ("p9",), (None,)], "probe string")
    got = annotate.in_file(spark, df, "probe", f"{folder}/probes.csv", "probe")
    assert {r.probe: r.listed for r in got.collect()} == {"p1": True, "p9": False, None: False}
    assert annotate.in_file(spark, df, "probe", f"{folder}/snps.txt", 0, "x", "\t").where("x").count() == 0


def test_intervals_of_any_length(spark):
    rng = random.Random(5)
    length = lambda: rng.choice([0, 1, 7, 300, 10**5, 9 * 10**8])
    spans = [(str(rng.randint(1, 2)), k, s, s + length()) for k in range(150) for s in [rng.randint(-(10**6), 10**9)]]
    points = [(str(rng.randint(1, 3)), p) for _, _, s, e in spans for p in (s, e, e + 1, rng.randint(0, 10**9))]
    frame = spark.createDataFrame(spans, "chr string, id int, start long, end long")
    asked = spark.createDataFrame(points, "chr string, pos long")
    joined = interval.stab_join(asked, frame, 10)
    want = sorted((c, p, k, s, e) for c, p in points for d, k, s, e in spans if c == d and s <= p <= e)
    assert sorted(tuple(r) for r in joined.collect()) == want
    assert "_bin" in joined._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("\n")[0]
    a = frame.select("chr", F.col("id").alias("a"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = frame.select("chr", F.col("id").alias("b"), (F.col("start") + 3).alias("b_start"), (F.col("end") - 1).alias("b_end"))
    pairs = interval.overlap_join(a, b, 10)
    want = sorted((d[1], e[1]) for d in spans for e in spans if d[0] == e[0] and e[2] + 3 <= e[3] - 1 and d[2] <= e[3] - 1 and e[2] + 3 <= d[3])
    assert sorted((r.a, r.b) for r in pairs.collect()) == want and pairs.columns == ["chr", "a", "a_start", "a_end", "b", "b_start", "b_end"]
    assert interval.stab_join(asked, frame.limit(0), 10).count() == 0
