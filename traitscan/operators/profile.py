"""Per-marker genotype profiles from arrays of two-letter symbols or from long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscan.functions import genotype as G


def profile_long(calls: DataFrame, marker: str = "marker", symbol: str = "symbol") -> DataFrame:
    """One row per marker from (marker, symbol): allele counts, genotype counts, alleles and MAF.

    Counts are summed before the shuffle, so a marker with very many calls is one
    row per task.
    """
    g = G.canonical(F.col(symbol))
    a, b = F.substring(symbol, 1, 1), F.substring(symbol, 2, 1)
    count = lambda x: F.sum((a == x).cast("long") + (b == x).cast("long"))
    het = F.sum(((a != b) & a.isin(*G.BASES) & b.isin(*G.BASES)).cast("long"))
    hom = F.sum(((a == b) & a.isin(*G.BASES)).cast("long"))
    out = calls.where(F.col(symbol).isNotNull()).groupBy(marker).agg(
        *(count(x).alias(f"n_{x}") for x in [*G.BASES, "0"]), hom.alias("n_hom"), het.alias("n_het"), F.sum((g == "00").cast("long")).alias("n_missing"), F.count(F.lit(1)).alias("n_calls")
    )
    counts = F.struct(*(F.col(f"n_{x}") for x in G.BASES))
    out = out.withColumn("_c", counts).withColumn("major", G.major_allele(F.col("_c"))).withColumn("minor", G.minor_allele(F.col("_c"), F.col("major")))
    of = lambda which: F.coalesce(*(F.when(F.col(which) == x, F.col(f"n_{x}")) for x in G.BASES), F.lit(0))
    return out.withColumn("maf", F.try_divide(F.least(of("major"), of("minor")), of("major") + of("minor"))).drop("_c")


def recode_additive(markers: DataFrame, symbols: str = "symbols") -> DataFrame:
    """Arrays of symbols to 0/1/2 minor alleles, with alleles, MAF and missing count."""
    out = markers.withColumn("_n", G.allele_counts(symbols))
    out = out.withColumn("major", G.major_allele(F.col("_n"))).withColumn("minor", G.minor_allele(F.col("_n"), F.col("major")))
    out = out.withColumn("codes", F.transform(symbols, lambda g: G.additive(g, F.col("major"), F.col("minor"))))
    known = F.filter("codes", lambda x: x.isNotNull())
    ones = F.aggregate(known, F.lit(0), lambda s, x: s + x)
    out = out.withColumn("n_missing", (F.size("codes") - F.size(known)).cast("long"))
    return out.withColumn("maf", F.try_divide(F.least(ones, 2 * F.size(known) - ones), 2 * F.size(known))).drop("_n")


def cis_trans_summary(pairs: DataFrame, value: str, below: float, marker: str = "marker", feature: str = "feature", flag: str = "is_cis") -> DataFrame:
    """Pairs, distinct markers and distinct features below a threshold, by flag and overall.

    One pass for both classes and their union: every marker and feature carries
    the set of its classes in the bits of one number, which tasks merge before
    they shuffle, and its pairs are counted by class on the way.
    """
    kept = pairs.where(F.col(value) < below)
    bit = F.when(F.col(flag).isNull(), F.lit(1)).when(F.col(flag), F.lit(2)).otherwise(F.lit(4))
    counts = [F.sum((bit == b).cast("long")).alias(f"_p{b}") for b in (1, 2, 4)]
    sets = lambda c: kept.groupBy(F.col(c).alias("_key")).agg(F.bit_or(bit).alias("_bits"), *counts)
    known = F.col("_key").isNotNull()

    def totals(keys: DataFrame, name: str) -> DataFrame:
        has = lambda b: F.count(F.when(known & (F.col("_bits").bitwiseAND(F.lit(b)) != 0), 1))
        return keys.agg(*(has(b).alias(f"{name}{b}") for b in (1, 2, 4, 7)), *(F.sum(f"_p{b}").alias(f"{name}_p{b}") for b in (1, 2, 4)))

    both = totals(sets(marker), "m").crossJoin(totals(sets(feature), "f"))  # of one row and one row
    p = lambda b: F.coalesce(f"m_p{b}", F.lit(0))
    row = lambda name, b, n: F.struct(F.lit(name).cast("string").alias("class"), n.alias("n_pairs"), F.col(f"m{b}").alias("n_markers"), F.col(f"f{b}").alias("n_features"))
    rows = F.array(row(None, 1, p(1)), row("true", 2, p(2)), row("false", 4, p(4)), row("all", 7, p(1) + p(2) + p(4)))
    return both.select(F.explode(rows).alias("r")).select("r.*").where("n_pairs > 0 or class = 'all'")
