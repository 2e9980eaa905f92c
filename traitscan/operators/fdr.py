"""log10 false discovery rates of ascending log10 p-values, without a global window.

c_k = min(0, p_k + log10 N - log10 k) with k from 0 (k + 1 for Benjamini-Hochberg),
then the running minimum from the end. Ranks and minima are found per range of
rows: small per-range totals give every range its offset and the minimum of all
later ranges. Equal p-values may lie in several ranges, in the order of `tie`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitscan.tables import ranked

#: Rows of one range.
RANGE_ROWS = 200_000


def log10_fdr(df: DataFrame, column: str = "log10p", tie: str = "id", log10_n: float | None = None, bh: bool = False) -> DataFrame:
    """df with rank (from 0) and log10fdr; rows without a p-value go."""
    rows = df.where(F.col(column).isNotNull())
    order = ranked(rows, [column, tie], "rank", RANGE_ROWS)
    n = order.select("_part").count() if log10_n is None else 0  # from the written ranges
    total = log10_n if log10_n is not None else math.log10(n) if n else 0.0
    k = F.col("rank") + (1 if bh else 0)
    c = F.when(k == 0, F.lit(0.0)).otherwise(F.least(F.lit(0.0), F.col(column) + total - F.log10(k)))
    scored = order.withColumn("_c", c)
    lows = scored.groupBy("_part").agg(F.min("_c").alias("_low"))  # one row per range
    later = lows.select("_part", F.min("_low").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    tail = Window.partitionBy("_part").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = scored.join(F.broadcast(later), "_part").withColumn("log10fdr", F.least(F.min("_c").over(tail), F.col("_later")))
    return out.drop("_part", "_c", "_later")
