"""The stateless tools on streams: filters and lookups run as they are; counts are windowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitscan.operators.annotate import filter_rows


def filter_stream(stream: DataFrame, condition: Column | str) -> DataFrame:
    return filter_rows(stream, condition)


def annotate_stream(stream: DataFrame, table: DataFrame, key: str, column: str) -> DataFrame:
    """A left lookup of stream rows in a static table with unique keys."""
    return stream.join(table.withColumnRenamed(key, "_k"), F.col(column) == F.col("_k"), "left").drop("_k")


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, by: str) -> DataFrame:
    """Rows per window and key; rows later than `late` are ignored."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))
