"""Operator 4: drop lines that are boilerplate of their site.

For each host, a line's ratio is the number of the host's pages that contain it,
divided by all pages of the host; lines above the ratio go, in every page of the
host. Native DataFrame operations throughout: pages are never regrouped. Only
(host, line hash) counts are shuffled, pre-aggregated; a host's boilerplate list
is bounded (lines per page / ratio) and reaches its pages as one array.

Cases: pages without a host form one host; a null text stays null; an empty text
is one empty line; empty lines count as lines but never are boilerplate; a line
repeated in one page counts once; a host with fewer than min_pages pages
containing a line keeps it; a text whose every line goes becomes empty; other
columns travel along, those named n_lines or n_dropped are replaced by the result's
unless counts is off. With copies_once, pages of a host with equal texts count as
one page, so that copies of a text cannot make its own lines boilerplate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscan.llm.common import shared_table

#: Hosts whose boilerplate lists may be broadcast together, and list entries in all.
LIST_ENTRIES = 500_000


def boilerplate_lines(pages: DataFrame, ratio: float, min_pages: int, host_col: str, text_col: str, copies_once: bool = False) -> DataFrame:
    """(host, line key) of all lines above the ratio."""
    host = F.col(host_col).alias("host")
    lines = F.array_distinct(F.split(text_col, "\n", -1))
    keys = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x))
    rows = pages.where(F.col(text_col).isNotNull()).select(host, F.xxhash64(text_col).alias("page"), F.explode(keys).alias("line"))
    if copies_once:
        rows = rows.groupBy("host", "line", "page").agg(F.lit(1))
    counts = rows.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    counts = shared_table(counts, "lines")
    texts = pages.select(host, F.xxhash64(text_col).alias("page"))
    totals = (texts.distinct() if copies_once else texts).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    same = F.col("host").eqNullSafe(F.col("h"))
    return counts.join(totals.withColumnRenamed("host", "h"), same).where(F.col("n") > F.col("pages") * ratio).select("host", "line")


def drop_boilerplate(pages: DataFrame, ratio: float = 0.1, min_pages: int = 3, host_col: str = "source", text_col: str = "text", copies_once: bool = False, counts: bool = True) -> DataFrame:
    """pages with the text's boilerplate lines dropped, and n_lines and n_dropped (unless counts is off)."""
    found = boilerplate_lines(pages, ratio, min_pages, host_col, text_col, copies_once)
    lists = shared_table(found.groupBy(F.col("host").alias("_h")).agg(F.collect_list("line").alias("_bad")), "boilerplate")
    size = lists.agg(F.count(F.lit(1)).alias("hosts"), F.sum(F.size("_bad")).alias("entries")).first()
    small = size.hosts + (size.entries or 0) <= LIST_ENTRIES
    out = pages.join(F.broadcast(lists) if small else lists, F.col(host_col).eqNullSafe(F.col("_h")), "left")
    lines = F.split(text_col, "\n", -1)
    left = F.when(F.col("_bad").isNull(), lines).otherwise(F.filter(lines, lambda x: (x == "") | ~F.array_contains("_bad", F.xxhash64(x))))
    out = out.withColumn("_left", left)
    if counts:
        known = lambda n: F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n).cast("long")
        out = out.withColumn("n_lines", known(F.size(lines))).withColumn("n_dropped", known(F.size(lines) - F.size("_left")))
    return out.withColumn(text_col, F.array_join("_left", "\n")).drop("_left", "_bad", "_h")
