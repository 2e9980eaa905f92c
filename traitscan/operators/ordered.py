"""Ordered analytics per series: sums, differences, runs, peaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitscan.tables import discard, ranges, written


def _sum_of(*parts: Column) -> Column:
    """Sum without the NULLs; NULL if all are."""
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
    return F.when(F.coalesce(*parts).isNotNull(), total)


def scan(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], reverse: bool = False, range_rows: int = 0, keep: Sequence[str] = ("cum_sum", "cum_prod", "cum_max", "diff")) -> DataFrame:
    """cum_sum, cum_prod, cum_max and diff (to the row before) along each series, forward or from its end.

    Ties in the order are taken by their place in the input. A table of more than
    range_rows (200,000) rows is scanned in two passes: rows are dealt to ranges of
    series and order, each range is scanned on its own, and what a series has
    gathered before a range is carried into it. So one series with all rows is the
    work of many tasks. NULLs add nothing, and differences to or from one are NULL.
    Products go by logarithms, with signs and zeros kept apart.
    """
    keys, by = list(order), list(by)
    cut = ranges(df, [*by, *keys], range_rows)
    rows = (df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.lit(0)) if cut is None else cut).withColumn("_v", F.col(value).cast("double"))
    way = F.desc if reverse else F.asc
    w = Window.partitionBy(*by, "_part").orderBy(*map(way, [*keys, "_row"]))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = F.col("_v")
    parts = {"_sum": F.sum(v), "_max": F.max(v), "_ln": F.sum(F.when(v != 0, F.ln(F.abs(v)))), "_neg": F.sum((v < 0).cast("double")), "_zero": F.sum((v == 0).cast("double"))}
    out = rows.withColumns({c: e.over(upto) for c, e in parts.items()} | {"_before": F.lag("_v").over(w), "_first": F.row_number().over(w) == 1})
    if cut is None:
        out = out.withColumns({f"_c{c}": F.lit(None).cast("double") for c in [*parts, "_last"]})
    else:
        place = F.struct(*keys, "_row")
        ends = rows.groupBy(*by, "_part").agg(*(e.alias(c) for c, e in parts.items()), (F.min_by if reverse else F.max_by)("_v", place).alias("_last"))
        over = Window.partitionBy(*by).orderBy(way("_part"))  # one row per series and range
        past = over.rowsBetween(Window.unboundedPreceding, -1)
        carried = {f"_c{c}": (F.max if c == "_max" else F.sum)(c).over(past) for c in parts} | {"_c_last": F.lag("_last").over(over)}
        carry = ends.withColumns(carried).select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(by)), F.col("_part").alias("_p"), *carried)
        same = F.col("_part") == F.col("_p")
        for k, c in enumerate(by):
            same &= F.col(c).eqNullSafe(F.col(f"_k{k}"))
        out = out.join(carry, same, "left")
    both = lambda c: _sum_of(F.col(c), F.col(f"_c{c}"))
    sign = F.when(F.coalesce(both("_neg"), F.lit(0.0)) % 2 == 1, -1.0).otherwise(1.0)
    product = F.when(both("_zero") > 0, 0.0).otherwise(sign * F.exp(F.coalesce(both("_ln"), F.lit(0.0))))
    made = {
        "cum_sum": both("_sum"), "cum_prod": F.when(both("_zero").isNotNull(), product), "cum_max": F.greatest("_max", "_c_max"),
        "diff": v - F.when(F.col("_first"), F.col("_c_last")).otherwise(F.col("_before")),
    }
    return out.select(*df.columns, *(made[c].alias(c) for c in keep))


def accumulate(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], reverse: bool = False, range_rows: int = 0) -> DataFrame:
    """cum_sum, diff (to the row before) and cum_max along a series, forward or from its end."""
    return scan(df, value, by, order, reverse, range_rows, ["cum_sum", "diff", "cum_max"])


def running_product(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], reverse: bool = False, range_rows: int = 0) -> DataFrame:
    """cum_prod along a series."""
    return scan(df, value, by, order, reverse, range_rows, ["cum_prod"])


def run_number(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Index from 0 of each distinct value in ascending order."""
    return df.withColumn("run", F.dense_rank().over(Window.partitionBy(*by).orderBy(value)) - 1)


def find_peaks(df: DataFrame, value: str, position: str, by: str, separation: float, block_rows: int = 50_000) -> DataFrame:
    """Local maxima of each series at least `separation` apart, the highest first (equal ones: the first position).

    Candidates are higher than the row before and not lower than the row after.
    With a separation, a candidate stays if no candidate that stays, comes before
    it in that order and lies nearer than the separation. A series is cut into
    blocks of at least four separations; a task knows the candidates of its block
    and those within a separation of its ends. It decides every candidate whose
    better neighbours are decided; what hangs on another block waits for the next
    round. A round writes the candidates that stay or wait.
    """
    w = Window.partitionBy(by).orderBy(position)
    last, after = F.lag(value).over(w), F.lead(value).over(w)
    some = df.withColumn("_l", last).withColumn("_a", after).where(f"(_l is null or {value} > _l) and (_a is null or {value} >= _a)").select(by, position, value)
    if separation <= 0:
        return some
    some = written(some.withColumn("_row", F.monotonically_increasing_id()), "candidates")
    size = some.groupBy(by).agg(F.min(position).alias("_from"), ((F.max(position) - F.min(position)) * block_rows / F.count(F.lit(1))).alias("_len")).withColumnRenamed(by, "_by")
    size = size.withColumn("_len", F.greatest(F.col("_len").cast("double"), F.lit(4.0 * separation)))
    place = (F.col(position) - F.col("_from")) / F.col("_len")
    blocked = some.join(size, F.col(by).eqNullSafe(F.col("_by"))).select(by, position, value, "_row", F.floor(place).alias("_block"), (F.col("_len") * (place - F.floor(place))).alias("_in"), "_len")
    state = written(blocked.withColumn("_kept", F.lit(False)), "peaks")
    discard(some)
    reach = separation * (1 + 1e-6)  # places are rounded
    own = F.array(F.lit(0), F.when(F.col("_in") < reach, -1), F.when(F.col("_len") - F.col("_in") < reach, 1))

    def decide(pdf):  # noqa: ANN001, ANN202
        import bisect

        pdf = pdf.sort_values([value, position, "_row"], ascending=[False, True, True])
        near: dict[bool, list] = {True: [], False: []}  # positions that stay, and that wait
        out = []
        hit = lambda found, p: (at := bisect.bisect_right(found, p - separation)) < len(found) and found[at] < p + separation
        for i, (p, kept, at) in enumerate(zip(pdf[position].tolist(), pdf["_kept"].tolist(), pdf["_to"].tolist(), strict=True)):
            if not kept:
                if hit(near[True], p):
                    continue
                kept = at == 0 and not hit(near[False], p)  # another block decides about its own
            bisect.insort(near[kept], p)
            if at == 0:
                out.append((i, kept))
        done = pdf.iloc[[i for i, _ in out]].drop(columns="_to")
        done["_kept"] = [k for _, k in out]
        return done

    schema = state.schema
    while state.where("not _kept").limit(1).count():
        dealt = state.withColumn("_to", F.explode(F.filter(own, lambda x: x.isNotNull())))
        dealt = dealt.withColumn("_at", F.col("_block") + F.col("_to"))
        last, state = state, written(dealt.groupBy(by, "_at").applyInPandas(lambda pdf: decide(pdf.drop(columns="_at")), schema), "peaks")
        discard(last)
    return state.select(by, position, value)


def top_k(df: DataFrame, by: str, order: Sequence, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)
