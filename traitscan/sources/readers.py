"""Sources: delimited matrices, covariates, PLINK files, annotation tables, archives."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitscan.sources.formats import absolute, registered

MISSING = ["", "-", "."]


def text_lines(spark: SparkSession, path: str, comments: Sequence[str] = ("#",)) -> DataFrame:
    """Lines (value, file) without comments and empty lines; .gz and .bz2 by their names."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    for c in comments:
        lines = lines.where(~F.col("value").startswith(c))
    return lines.where(F.trim("value") != "")


def _cells(delimiters: str) -> Column:
    return F.split(F.trim("value"), f"[{delimiters}]", -1)


def matrix_table(spark: SparkSession, path: str, header: bool = True, delimiters: str = " \t,", encoded: bool = False) -> DataFrame:
    """(id, values array<double>) of a delimited matrix; blanks (and - . if encoded) are NULL.

    Every delimiter ends a cell. Rows of another width than the header's are an error.
    """
    lines = text_lines(spark, path).withColumn("cells", _cells(delimiters))
    names: list[str] | None = None
    body = F.lit(True)
    if header:
        first = lines.first()
        names = first.cells if first else []
        body = F.col("value") != (first.value if first else "")
        lines = lines.where(body)
    blank = MISSING if encoded else [""]
    value = lambda x: F.when(F.trim(x).isin(*blank), F.lit(None)).otherwise(F.trim(x).cast("double"))
    rows = lines.select(F.element_at("cells", 1).alias("id"), F.when(body, F.transform(F.slice("cells", F.lit(2), F.size("cells") - 1), value)).alias("values"))  # filters may move: the header is never cast
    if names is not None:
        width = len(names) - 1
        bad = F.raise_error(F.format_string("%s: %d vs %d", "id", F.size("values"), F.lit(width)))
        rows = rows.withColumn("values", F.when(F.col("values").isNull() | (F.size("values") == width), F.col("values")).otherwise(bad.cast("array<double>")))
    return rows


def sample_names(spark: SparkSession, path: str, delimiters: str = " \t,") -> list[str]:
    first = text_lines(spark, path).withColumn("cells", _cells(delimiters)).first()
    return first.cells[1:] if first else []


def covariate_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A typed table of samples; text columns are categories."""
    return spark.read.csv(path, header=True, sep=sep, comment="#", inferSchema=True)


def categories(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes from 0 in alphabetical order; blanks have none."""
    from pyspark.sql import Window

    values = df.where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).select(F.col(column).cast("string").alias("value")).distinct()
    return values.withColumn("code", F.row_number().over(Window.orderBy("value")) - 1)


def parse_tped(lines: DataFrame) -> DataFrame:
    """(chrom, id, pos, tokens) of the lines (value) of a transposed genotype file; the genetic distance is dropped.

    Chromosomes stay text, as X, Y and MT are no numbers.
    """
    cells = lines.withColumn("cells", F.split(F.trim("value"), "[ \t,\f]+"))
    cells = cells.where(F.element_at("cells", 4).try_cast("int").isNotNull())  # a header has no number there
    at = lambda k: F.element_at("cells", k)
    return cells.select(at(1).alias("chrom"), at(2).alias("id"), at(4).cast("int").alias("pos"), F.slice("cells", F.lit(5), F.size("cells") - 4).alias("tokens"))


def is_archive(path: str) -> bool:
    return path.lower().endswith((".tar", ".tgz", ".tar.gz", ".tar.bz2"))


def member_lines(spark: SparkSession, path: str, suffixes: Sequence[str], comments: Sequence[str] = ("#", "//")) -> DataFrame:
    """The lines (value) of a plain file, or of an archive's members with one of the suffixes."""
    if not is_archive(path):
        return text_lines(spark, path, comments).select("value")
    lines = read_tar(spark, path, suffixes)
    for c in comments:
        lines = lines.where(~F.col("value").startswith(c))
    return lines.where(F.trim("value") != "").select("value")


def read_tped(spark: SparkSession, path: str) -> DataFrame:
    """parse_tped of a file, or of the .tped members of a tar archive."""
    return parse_tped(member_lines(spark, path, (".tped",)))


def read_plink(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(genotypes, family) of several files whose roles their suffixes tell: .tped, .tfam or .fam, archives of both."""
    some = lambda ends: [p for p in paths if p.lower().endswith(ends) or is_archive(p)]
    union = lambda read, ends: functools.reduce(DataFrame.unionByName, [read(spark, p) for p in some(ends)])
    for ends in (".tped",), (".tfam", ".fam"):
        if not some(ends):
            raise ValueError(f"no {' or '.join(ends)} file among {', '.join(paths)}")
    return union(read_tped, (".tped",)), union(read_fam, (".tfam", ".fam"))


def tped_symbols(tped: DataFrame) -> DataFrame:
    """Pairs of allele tokens as two-letter symbols, 0 for a missing allele."""
    letter = lambda x: F.when(x.isin("A", "C", "G", "T"), x).otherwise(F.lit("0"))
    pair = lambda i: F.concat(letter(F.element_at("tokens", (2 * i + 1).cast("int"))), letter(F.element_at("tokens", (2 * i + 2).cast("int"))))
    n = F.floor(F.size("tokens") / 2).cast("int")
    return tped.withColumn("symbols", F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pair)).otherwise(F.array().cast("array<string>"))).drop("tokens")


def tped_dosages(tped: DataFrame) -> DataFrame:
    return tped.withColumn("values", F.transform("tokens", lambda x: x.try_cast("double"))).drop("tokens")


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """(family_id, subject_id, father_id, mother_id, sex); a subject named twice is an error."""
    cells = member_lines(spark, path, (".tfam", ".fam")).withColumn("c", F.split(F.trim("value"), "[ \t,]+"))
    at = lambda k: F.element_at("c", k)
    sex = F.when(at(5) == "1", "M").when(at(5) == "2", "F").otherwise("U")
    out = cells.where(at(5).try_cast("int").isNotNull()).select(at(1).alias("family_id"), at(2).alias("subject_id"), at(3).alias("father_id"), at(4).alias("mother_id"), sex.alias("sex"))
    twice = out.groupBy("subject_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"subject {twice[0].subject_id} occurs {twice[0]['count']} times")
    return out


def subject_order(spark: SparkSession, path: str) -> list[str]:
    """The subjects of a family file in its order; one for each sample."""
    rows = read_fam(spark, path).select("subject_id", F.monotonically_increasing_id().alias("at"))
    return [r.subject_id for r in sorted(rows.collect(), key=lambda r: r["at"])]


def read_tar(spark: SparkSession, path: str, suffixes: Sequence[str] = (".tped", ".tfam")) -> DataFrame:
    """(name, value): the lines of the wanted members of tar, tar.gz and tar.bz2 archives of any size, streamed."""
    return registered(spark).read.format("archive_lines").option("path", absolute(path)).option("suffixes", ",".join(suffixes)).load()


def read_binary_matrix(spark: SparkSession, path: str, rows_per_task: int = 0) -> DataFrame:
    """(id, values) of big-endian matrix files of any size: 8 ints of shape, names, then doubles by row.

    path is a file, a folder or a pattern; a task reads a range of rows.
    """
    return registered(spark).read.format("matrix_file").option("path", absolute(path)).option("rows_per_task", rows_per_task).load()


def annotation_table(spark: SparkSession, path: str, key: str, kept: Sequence[str] = (), rename: dict[str, str] | None = None, sep: str = ",", rules: dict[str, str] | None = None) -> DataFrame:
    """Text columns of an annotation file, chosen, computed and renamed; the last row of a key wins."""
    from traitscan.operators.annotate import last_per_key

    df = spark.read.csv(path, header=True, sep=sep, comment="#").withColumn("_o", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    for name, rule in (rules or {}).items():
        df = df.withColumn(name, F.expr(rule))
    kept = [*dict.fromkeys([key, *(kept or [c for c in df.columns if c != "_o"])])]
    return last_per_key(df.select(*kept, "_o"), key, ["_o"]).select(*kept).withColumnsRenamed(rename or {})


def positional_table(spark: SparkSession, path: str, columns: dict[str, int], sep: str = ",", header: bool = True) -> DataFrame:
    """Chosen columns of a delimited file by place (from 0); a leading chr of `chr` is stripped."""
    df = spark.read.csv(path, header=header, sep=sep)
    out = df.select(*(F.col(f"`{df.columns[i]}`").alias(name) for name, i in columns.items()))
    return out.withColumn("chr", F.regexp_replace("chr", "^chr", "")) if "chr" in columns else out


def read_ini(text: str, sections: bool = False) -> dict:
    """Keys in lower case; comments start with # ; or //. With sections, {section: {key: value}}."""
    out: dict = {}
    here = out
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line[0] in "#;" or line.startswith("//"):
            continue
        if sections and line.startswith("[") and line.endswith("]"):
            here = out.setdefault(line[1:-1], {})
            continue
        key, eq, value = line.partition("=")
        if not eq:
            if sections:
                raise ValueError(f"no = in {line!r}")
            break
        if sections and not (key.strip() and value.strip()):
            raise ValueError(f"empty key or value in {line!r}")
        here[key.strip() if sections else key.strip().lower()] = value.strip()
    return out


def write_ini(values: dict[str, str]) -> str:
    return "".join(f"{k}={values[k]}\n" for k in sorted(values))
