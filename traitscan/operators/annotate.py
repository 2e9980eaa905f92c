"""Lookup joins, row filters and column plans of the annotation tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitscan.tables import ranked


def last_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the last by `order`; aggregated before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def lookup_side(table: DataFrame, rows: int = 500_000) -> DataFrame:
    """table, marked for a broadcast if a count shows that it is small."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def annotate(main: DataFrame, sections: dict[str, tuple[DataFrame, str, str]], rows: int = 500_000) -> DataFrame:
    """Left lookups of main rows in unique-key sections: {name: (table, its key, main's column)}.

    Section columns come first, named name.column, in the order of the sections;
    a miss gives NULL. A section is broadcast only when a count shows it small.
    """
    out, first = main.alias("Main"), []
    for name, (table, key, column) in sections.items():
        side = table.select(F.col(key).alias("_k"), *(F.col(c).alias(f"{name}.{c}") for c in table.columns if c != key))
        out = out.join(lookup_side(side, rows), F.col(column) == F.col("_k"), "left").drop("_k")
        first += [f"`{name}.{c}`" for c in table.columns if c != key]
    return out.select(*first, *main.columns)


def project(df: DataFrame, order: Sequence[str] | None = None, rename: dict[str, str] | None = None, computed: dict[str, Column | str] | None = None) -> DataFrame:
    """Computed columns, then the chosen order, then new names. Unknown or ambiguous names are errors."""
    for name, rule in (computed or {}).items():
        df = df.withColumn(name, F.expr(rule) if isinstance(rule, str) else rule)
    picked = [f"`{c}`" for c in (order or df.columns)]
    df = df.select(*picked)
    return df.withColumnsRenamed(rename or {})


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows where the condition is true; rows for which it cannot be evaluated go.

    Text cells are read as numbers with try_cast or functions.arrays.num, which
    gives NULL instead of an error.
    """
    return df.where(F.expr(condition) if isinstance(condition, str) else condition)


def filter_count(df: DataFrame, condition: Column | str) -> DataFrame:
    return filter_rows(df, condition).agg(F.count(F.lit(1)).alias("n_rows"))


def in_table(df: DataFrame, column: str, table: DataFrame, key: str, flag: str) -> DataFrame:
    """df with a boolean that tells whether column is among the keys; can stand inside any OR or NOT."""
    keys = table.select(F.col(key).alias("_k")).where(F.col(key).isNotNull()).distinct().withColumn("_hit", F.lit(True))
    return df.join(keys, F.col(column) == F.col("_k"), "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")


def in_file(spark: SparkSession, df: DataFrame, column: str, path: str, key: str | int = 0, flag: str = "listed", sep: str = ",", header: bool = True) -> DataFrame:
    """in_table for one column of a delimited file, by its name or its place from 0; cells are trimmed."""
    listed = spark.read.options(header=header, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    name = listed.columns[key] if isinstance(key, int) else key
    return in_table(df, column, listed.select(F.col(f"`{name}`").alias("_listed")), "_listed", flag)


def translate_ids(df: DataFrame, column: str, table: DataFrame, key: str, value: str, order: Sequence[str], to: str) -> DataFrame:
    """column replaced through a key-value table whose last duplicate wins; NULL on a miss."""
    pairs = last_per_key(table.select(key, value, *[c for c in order if c not in (key, value)]), key, order).select(F.col(key).alias("_k"), F.col(value).alias(to))
    return df.join(pairs, F.col(column) == F.col("_k"), "left").drop("_k")


def resolve_parents(people: DataFrame) -> DataFrame:
    """Pedigree rows (family_id, subject_id, father_id, mother_id, sex) with both parents' sexes."""
    side = lambda who: people.select(F.col("family_id"), F.col("subject_id").alias(f"{who}_id"), F.col("sex").alias(f"{who}_sex"))
    return people.join(side("father"), ["family_id", "father_id"], "left").join(side("mother"), ["family_id", "mother_id"], "left")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merge_sorted(parts: Sequence[DataFrame], column: str, *ties: str) -> DataFrame:
    """Union of tables with one header, ascending on a numeric column."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn(column, F.col(column).try_cast("double")).orderBy(column, *ties)


def split_every(df: DataFrame, rows: int, order: Sequence[str], name: str = "file_no") -> DataFrame:
    """Number the rows in order (row_no, from 0) and cut them every `rows` rows, without one global window."""
    out = ranked(df, list(order))
    return out.withColumn(name, F.floor(F.col("row_no") / rows).cast("long")).drop("_part")
