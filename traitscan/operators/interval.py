"""Point-in-interval joins on (chromosome, position), by bins instead of a range scan.

Intervals are closed and of any length. Bins form levels of doubling width; an
interval lies in the one to three bins it touches on the level whose bins are
about as long as itself, and a point asks for its bin on every level that some
interval uses. So no interval is copied to many bins, no join is on the chromosome
alone, and as the bins of a level are not much longer than their intervals, most
candidates are results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 1_000_000
#: Rows of one place, or of one interval, that are joined as one.
GROUP_ROWS = 4096


def _level(start: str, end: str, bin_width: float) -> Column:
    """The level whose bins, bin_width * 2 ** level, are just longer than the interval."""
    return F.greatest(F.lit(0), F.ceil(F.log2((F.col(end) - F.col(start) + 1) / bin_width))).cast("int")


def _bin(pos: str | Column, level: Column, bin_width: float) -> Column:
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / (F.lit(float(bin_width)) * F.pow(F.lit(2.0), level)))


def _grouped(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows of equal keys as arrays of at most GROUP_ROWS structs of the other columns; rows with a null key go."""
    rest = [F.col(c) for c in df.columns if c not in keys] or [F.lit(0).alias("_one")]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    dealt = df.dropna(subset=keys).withColumn("_group", F.floor((place - 1) / GROUP_ROWS))
    return dealt.groupBy(*keys, "_group").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("_group")


def _unfolded(hits: DataFrame, arrays: list[str], columns: list[str]) -> DataFrame:
    """All combinations of the rows in the arrays, those of the last array innermost: values of the others come in runs."""
    for name in arrays:
        hits = hits.withColumn(name, F.explode(name))
    inside = {f.name: f"{name}.{f.name}" for name in arrays for f in hits.schema[name].dataType.fields}
    return hits.select(*(F.col(inside.get(c, c)).alias(c) for c in columns))


def _levels(intervals: DataFrame, bin_width: float, start: str, end: str) -> list[int]:
    """The levels in use, as many as doublings of the width at most."""
    return sorted(r[0] for r in intervals.where(F.col(start) <= F.col(end)).select(_level(start, end, bin_width)).distinct().collect()) or [0]


def _stabs(points: DataFrame, intervals: DataFrame, bin_width: float, used: list[int], chrom: str, pos: str, start: str, end: str) -> DataFrame:
    """stab_join on tables without repeated places and intervals."""
    some = [c for c in intervals.columns if c != chrom]
    level = F.col("_level")
    dealt = intervals.where(F.col(start) <= F.col(end)).withColumn("_level", _level(start, end, bin_width))
    dealt = dealt.withColumn("_bin", F.explode(F.sequence(_bin(start, level, bin_width), _bin(end, level, bin_width))))
    asks = F.array(*(F.struct(F.lit(n).alias("_level"), _bin(pos, F.lit(n), bin_width).alias("_bin")) for n in used))
    asked = points.withColumn("_ask", F.explode(asks)).select(*points.columns, "_ask._level", "_ask._bin")
    hits = asked.join(dealt, [chrom, "_level", "_bin"]).where(F.col(pos).between(F.col(start), F.col(end)))
    return hits.select(*points.columns, *some)


def stab_join(points: DataFrame, intervals: DataFrame, bin_width: float, chrom: str = "chr", pos: str = "pos", start: str = "start", end: str = "end") -> DataFrame:
    """Inner join of points with the intervals that contain them; columns of both sides.

    bin_width is the width of the finest bins. Intervals without a start or an
    end, or that end before they start, hold nothing. Points of one place and equal
    intervals are joined as groups, so a pair of rows is only made where it is a
    result.
    """
    used = _levels(intervals, bin_width, start, end)
    places, spans = _grouped(points, [chrom, pos], "_points"), _grouped(intervals, [chrom, start, end], "_intervals")
    hits = _stabs(places, spans, bin_width, used, chrom, pos, start, end)
    return _unfolded(hits, ["_intervals", "_points"], [*points.columns, *(c for c in intervals.columns if c != chrom)])


def cis_window(points: DataFrame, sites: DataFrame, window: int = WINDOW, chrom: str = "chr", pos: str = "pos", site: str = "site_pos") -> DataFrame:
    """Points within `window` of a site on the same chromosome, with the signed distance."""
    low, high = F.greatest(F.lit(0).cast("bigint"), F.col(site) - window).alias("_lo"), (F.col(site) + window).alias("_hi")
    used = _levels(sites.select(low, high), max(1, window), "_lo", "_hi")
    places, spots = _grouped(points, [chrom, pos], "_points"), _grouped(sites, [chrom, site], "_sites")
    hits = _stabs(places, spots.select("*", low, high), max(1, window), used, chrom, pos, "_lo", "_hi")
    out = _unfolded(hits, ["_sites", "_points"], [*points.columns, *(c for c in sites.columns if c != chrom)])
    return out.withColumn("distance", F.col(pos) - F.col(site))


def overlap_join(a: DataFrame, b: DataFrame, bin_width: float, chrom: str = "chr") -> DataFrame:
    """Pairs of closed intervals (a_start, a_end) and (b_start, b_end) that share a position.

    Two intervals overlap if one holds the later start of both.
    """
    a, b = a.where("a_start <= a_end"), b.where("b_start <= b_end")
    order = [chrom, *(c for c in [*a.columns, *b.columns] if c != chrom)]
    of_a, of_b = _levels(a, bin_width, "a_start", "a_end"), _levels(b, bin_width, "b_start", "b_end")
    a, b = _grouped(a, [chrom, "a_start", "a_end"], "_a"), _grouped(b, [chrom, "b_start", "b_end"], "_b")
    later_a = _stabs(a, b, bin_width, of_b, chrom, "a_start", "b_start", "b_end")
    later_b = _stabs(b, a, bin_width, of_a, chrom, "b_start", "a_start", "a_end").where("b_start > a_start")
    return _unfolded(later_a.unionByName(later_b), ["_b", "_a"], order)


def stab_payloads(points: DataFrame, intervals: DataFrame, bin_width: float, payload: str, chrom: str = "chr", pos: str = "pos", start: str = "start", end: str = "end", by: list[str] | None = None) -> DataFrame:
    """For every point inside an interval the union of the payloads of all intervals that hold it, sorted.

    Points that agree in the columns `by` (all columns if none are named) are one
    point and get the union over their positions. Distinct places meet distinct
    intervals, so repeated ones make no pairs.
    """
    spots, spans = points.select(chrom, pos).distinct(), intervals.select(chrom, start, end, payload).distinct()
    sets = _stabs(spots, spans, bin_width, _levels(intervals, bin_width, start, end), chrom, pos, start, end).groupBy(chrom, pos).agg(F.collect_set(payload).alias("_set"))
    union = F.sort_array(F.array_distinct(F.flatten(F.collect_list("_set"))))
    return points.join(sets, [chrom, pos]).groupBy(*(by or points.columns)).agg(union.alias(payload))


def stab_totals(points: DataFrame, intervals: DataFrame, totals: dict[str, tuple[str, Column]], keys: list[str], pos: str = "pos", start: str = "start", end: str = "end") -> DataFrame:
    """keys, pos and the totals over the intervals that hold the position, a row for each place inside an interval; positions are whole numbers.

    totals: for each name "sum", "min" or "max" and its value from the columns of
    an interval. No pair of a point and an interval is made: an interval is the
    disjoint union of at most two dyadic bins a level, up to the span of the
    points, totals are kept for bins, and a point adds up the bins that it lies
    in, one a level. Bins narrower than a block of 2 ** cut positions are made
    where the block's points are, after the one exchange of the rows; wider ones
    are summed before they move. A place whose totals are all null has no row.
    """
    low, high = points.agg(F.min(pos), F.max(pos)).first()
    low, high = (low, high) if low is not None else (0, 0)
    top = max(2, int(high - low + 1).bit_length())  # no interval, cut to the points' span, fills a bin of this level
    cut = 2 * top // 3
    merged = [F.expr(f"{how}({name})").alias(name) for name, (how, _) in totals.items()]
    place = lambda c: (c - F.lit(low)).cast("bigint")
    held = intervals.dropna(subset=[*keys, start, end]).where((F.col(start) <= F.col(end)) & (F.col(start) <= high) & (F.col(end) >= low))
    held = held.select(*keys, place(F.greatest(F.col(start), F.lit(low))).alias("_s"), (place(F.least(F.col(end), F.lit(high))) + 1).alias("_e"), *(v.alias(n) for n, (_, v) in totals.items()))

    def cell(k: int, bin: Column) -> Column:
        """One number for a bin and its level: twice the bin's middle."""
        return F.shiftleft(bin * 2 + 1, k)

    def bins(levels: range, left: Column, right: Column) -> Column:
        """The interval's bins on these levels, those at its start if left and those at its end if right, or null."""
        found = []
        for k in levels:
            first, last = F.shiftright(F.col("_s") + (2**k - 1), k), F.shiftright("_e", k)  # bins from first to before last lie inside
            found += [F.when(left & (first < last) & (first.bitwiseAND(1) == 1), cell(k, first)), F.when(right & (first < last) & (last.bitwiseAND(1) == 1), cell(k, last - 1))]
        return F.array(*found)

    asks = lambda levels: F.array(*(cell(k, F.shiftright("_x", k)) for k in levels))
    dealt = lambda df, found: df.withColumn("_cell", F.explode(found)).where("_cell is not null")
    wide = dealt(held, bins(range(cut, top), F.lit(True), F.lit(True))).groupBy(*keys, "_cell").agg(*merged)

    spots = points.dropna(subset=[*keys, pos]).select(*keys, place(F.col(pos)).alias("_x")).withColumn("_block", F.shiftright("_x", cut))
    blocks = spots.select(*keys, "_block").distinct().withColumn("_x", F.shiftleft("_block", cut))
    base = dealt(blocks, asks(range(cut, top))).join(wide, [*keys, "_cell"]).groupBy(*keys, "_block").agg(*merged)

    inner = lambda c: F.when(F.col(c).bitwiseAND(2**cut - 1) != 0, F.shiftright(c, cut))  # noqa: E731  an end on a block's edge has no narrow bins
    parts = held.withColumn("_block", F.explode(F.array_distinct(F.array(inner("_s"), inner("_e"))))).where("_block is not null")
    rows = parts.unionByName(spots, allowMissingColumns=True).repartition(*keys, "_block").groupBy(*keys, "_block", "_s", "_e", "_x").agg(*merged)  # equal ones once
    mine = lambda c: F.shiftright(c, cut) == F.col("_block")
    cells = dealt(rows, F.when(F.col("_x").isNull(), bins(range(cut), mine("_s"), mine("_e"))).otherwise(asks(range(cut)))).groupBy(*keys, "_block", "_cell", "_x").agg(*merged)
    window = Window.partitionBy(*keys, "_block", "_cell")
    told = cells.select(*keys, "_block", "_x", *(F.expr(f"{how}({n})").over(window).alias(n) for n, (how, _) in totals.items())).where("_x is not null")
    narrow = told.groupBy(*keys, "_block", "_x").agg(*merged)
    both = narrow.join(base.select(*keys, "_block", *(F.col(n).alias(f"_{n}") for n in totals)), [*keys, "_block"], "left")
    add = {"sum": lambda x, y: F.coalesce(x + y, x, y), "min": F.least, "max": F.greatest}
    out = both.select(*keys, (F.col("_x") + F.lit(low)).alias(pos), *(add[how](F.col(n), F.col(f"_{n}")).alias(n) for n, (how, _) in totals.items()))
    return out.where(F.coalesce(*totals).isNotNull())


def long_cis_counts(points: DataFrame, sites: DataFrame, window: int = WINDOW, chrom: str = "chr", pos: str = "pos", site: str = "site_pos") -> DataFrame:
    """For every point the number of sites on its chromosome farther away than `window`; positions are whole numbers.

    far = all on the chromosome - those within the window, and those are the sites
    up to pos + window less those below pos - window. Counts up to a position are
    the totals of the bins before it and a running sum inside its bin, so no pair
    of a point and a site is made.
    """
    known = sites.where(F.col(site).isNotNull())
    counts = known.groupBy(chrom, F.col(site).cast("bigint").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    spots = points.where(F.col(pos).isNotNull()).select(chrom, pos).distinct()
    ends = F.array(F.struct((F.col(pos) + window).cast("bigint").alias("_x"), F.lit(1).alias("_s")), F.struct((F.col(pos) - window - 1).cast("bigint").alias("_x"), F.lit(-1).alias("_s")))
    asked = spots.withColumn("_e", F.explode(ends)).select(chrom, pos, "_e._x", "_e._s", F.lit(0).cast("bigint").alias("_n"))
    marks = asked.unionByName(counts, allowMissingColumns=True).withColumn("_bin", F.floor(F.col("_x") / max(1, window)))
    bins = marks.groupBy(chrom, "_bin").agg(F.sum("_n").alias("_total"))
    before = bins.withColumn("_before", F.sum("_total").over(Window.partitionBy(chrom).orderBy("_bin")) - F.col("_total")).drop("_total")
    upto = marks.withColumn("_upto", F.sum("_n").over(Window.partitionBy(chrom, "_bin").orderBy("_x"))).where("_s is not null").join(before, [chrom, "_bin"])
    near = upto.groupBy(chrom, pos).agg(F.sum(F.col("_s") * (F.col("_upto") + F.col("_before"))).alias("_near"))
    totals = known.groupBy(chrom).agg(F.count(F.lit(1)).alias("_all"))
    out = points.join(totals, chrom, "left").join(near, [chrom, pos], "left")
    far = F.coalesce("_all", F.lit(0)) - F.coalesce("_near", F.lit(0))
    return out.withColumn("n_long_cis", F.when(F.col(pos).isNull(), F.lit(0)).otherwise(far).cast("long")).drop("_all", "_near")
