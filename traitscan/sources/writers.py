"""Sinks: pair tables, encoded genotypes, split files, matrices."""

from __future__ import annotations

import struct

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitscan.operators.annotate import split_every
from traitscan.sources.formats import absolute, matrix_header, registered
from traitscan.tables import RANGE_ROWS

HEADERS = {"x_id": "Rs_ID", "y_id": "ProbesetID", "rsq": "RSq", "fx": "Fx", "t": "T", "log10p": "log10P", "dir": "Dir"}  # fixed values: column names of the pair file


def write_pairs(pairs: DataFrame, path: str, mode: str = "error") -> None:
    """Pairs as CSV with the customary header; row order is not defined."""
    pairs.withColumnsRenamed(HEADERS).write.mode(mode).csv(path, header=True)


def encoded_lines(markers: DataFrame) -> DataFrame:
    """One text line per marker (chrom, id, pos, codes): NULL codes as -."""
    codes = F.array_join(F.transform("codes", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), " ")
    return markers.select(F.concat_ws(" ", F.col("chrom").cast("string"), F.concat(F.lit("ss"), "id"), F.lit("0"), F.col("pos").cast("string"), codes).alias("value"))


def write_split(df: DataFrame, path: str, rows: int) -> None:
    """CSV files of at most `rows` rows, each with the header."""
    df.write.option("maxRecordsPerFile", rows).csv(path, header=True)


def write_numbered(df: DataFrame, folder: str, rows: int, order: Sequence[str], prefix: str = "part-", suffix: str = ".csv") -> None:
    """CSV files of exactly `rows` rows each in the order (the last may have fewer): file k is prefix, k, suffix, and has the header."""
    cells = F.to_csv(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    _numbered(split_every(df.withColumn("_line", cells), rows, order).select("file_no", "row_no", F.col("_line").alias("line")), folder, prefix, suffix, ",".join(df.columns))


def cut_lines(spark: SparkSession, path: str, folder: str, rows: int, prefix: str = "part-", suffix: str = ".csv") -> None:
    """The lines of a text file in files of `rows` lines each, under the first line as header, as they are."""
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    first = lines.orderBy("_block", "_at").first()
    if first is not None:
        body = lines.where((F.col("_at") != first["_at"]))
        _numbered(split_every(body, rows, ["_block", "_at"]).select("file_no", "row_no", F.col("value").alias("line")), folder, prefix, suffix, first.value)


def _numbered(lines: DataFrame, folder: str, prefix: str, suffix: str, header: str) -> None:
    tasks = max(1, -(-lines.count() // RANGE_ROWS))
    dealt = lines.repartitionByRange(tasks, "file_no").sortWithinPartitions("file_no", "row_no").select("file_no", "line")
    registered(lines.sparkSession)
    dealt.write.format("numbered_files").mode("append").options(path=absolute(folder), prefix=prefix, suffix=suffix, header=header).save()


def write_matrix(df: DataFrame, path: str, sep: str = "\t") -> None:
    """(id, values) as delimited text; NULL cells are blank."""
    cells = F.array_join(F.transform("values", lambda x: F.coalesce(x.cast("string"), F.lit(""))), sep)
    df.select(F.concat(F.col("id").cast("string"), F.lit(sep), cells).alias("value")).write.text(path)


def binary_matrix(ids: list[str], columns: list[str], rows: list[list[float]]) -> bytes:
    """The big-endian matrix file of a small matrix; write_matrix_files writes those of any size."""
    return matrix_header(len(rows), columns, len(columns), ids) + b"".join(struct.pack(f">{len(r)}d", *r) for r in rows)
