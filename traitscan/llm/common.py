"""Shared helpers: tables in the shared folder, checked broadcasts, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitscan.tables import written as shared_table

#: Rows up to which a table of a few machine words per row may be broadcast.
BROADCAST_ROWS = 200_000
#: A key with more than 1/HOT_SHARE of all rows is hot; there are at most HOT_SHARE such keys.
HOT_SHARE = 500


def drop_shared(df: DataFrame) -> None:
    """Delete the files behind a shared_table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the Arrow batches of text tables, so that Python workers stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ddl(df: DataFrame) -> str:
    """The columns of df as a schema string for functions on Arrow batches."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for a broadcast only if a count proves that it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def edges_min(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def are_stars(edges: DataFrame) -> bool:
    """Whether every u of distinct edges (u, v), u > v, has one v, and no v is a u: nothing is left to do."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    roles = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return not roles.where("ups > 1 or ups = 1 and low = 0").limit(1).count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of `edges`; root is the least node reachable.

    Alternates large-star and small-star steps until the edge set is a set of
    stars, which may be before the first step. Minima are pre-aggregated, so a
    node with very many neighbours moves one row per task; every round is written
    to the shared folder. Nothing is collected but whether a row is no star.
    Self-loops and repeats are allowed.
    """
    E = shared_table(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    while not are_stars(E):
        both = E.select("u", "v").union(E.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = edges_min(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge of `large` has u > v
        low = edges_min(large)
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = shared_table(small, "edges")
        drop_shared(E)
        E = new
    return E.select(F.col("u").alias("node"), F.col("v").alias("root")).union(E.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
