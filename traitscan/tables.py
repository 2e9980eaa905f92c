"""Tables that a job writes once and reads again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one range of ranked.
RANGE_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local master (tests); a
    cluster without the setting is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back.

    This cuts the lineage: later steps, also after a lost executor, start from
    the files.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def ranges(df: DataFrame, order: list[str], range_rows: int = 0) -> DataFrame | None:
    """df with _row, the place in the input, and _part, its range in the order (ties by _row), written; None for one range.

    Rows are dealt to ranges of about range_rows and written, as a range exchange
    that is planned twice may draw other bounds. Equal rows may lie in several
    ranges.
    """
    parts = -(-df.count() // (range_rows or RANGE_ROWS))
    if parts <= 1:
        return None
    keys = [*order, "_row"]
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    return written(rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranges")


def ranked(df: DataFrame, order: list[str], name: str = "row_no", range_rows: int = 0) -> DataFrame:
    """df with `name`, the place of each row in the order (from 0), and _part, its range.

    No window spans the table: rows are dealt to ranges of about range_rows and
    written, as a range exchange that is planned twice may draw other bounds;
    the counts of the ranges give each its offset. Rows that are equal in all of
    `order` are told apart by their place in the input, so they may lie in
    several ranges.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    parts = max(1, -(-df.count() // (range_rows or RANGE_ROWS)))
    keys = [*order, "_row"]
    ranged = written(rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row per range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1 + F.col("_before")
    return ranged.join(F.broadcast(before), "_part").withColumn(name, place.cast("long")).drop("_before", "_row")
