"""Allele and genotype recoding as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ["A", "C", "G", "T"]


def decode_allele(c: Column) -> Column:
    """A, C, G, T as they are; - ? 0 and anything else are missing."""
    return F.when(c.isin(*BASES), c)


def genotype(a: Column, b: Column) -> Column:
    """Both alleles in order; missing if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(F.least(a, b), F.greatest(a, b)))


def canonical(symbol: Column) -> Column:
    """CA as AC, 0T as T0: bases in order, the missing sign last."""
    a, b = F.substring(symbol, 1, 1), F.substring(symbol, 2, 1)
    rank = lambda x: F.when(x == "0", F.lit("~")).otherwise(x)
    return F.when(rank(a) <= rank(b), F.concat(a, b)).otherwise(F.concat(b, a))


def alleles_of(symbols: Column | str) -> Column:
    """All single alleles of an array of two-letter symbols."""
    return F.flatten(F.transform(symbols, lambda g: F.array(F.substring(g, 1, 1), F.substring(g, 2, 1))))


def _is(base: str):  # noqa: ANN202
    return lambda x: x == base


def allele_counts(symbols: Column | str) -> Column:
    """Struct of counts of A, C, G, T and 0."""
    all_ = alleles_of(symbols)
    return F.struct(*(F.size(F.filter(all_, _is(b))).cast("long").alias(f"n_{b}") for b in [*BASES, "0"]))


def major_allele(counts: Column) -> Column:
    """The first of the most frequent alleles; NULL if none was seen."""
    top = F.greatest(*(counts[f"n_{b}"] for b in BASES))
    pick = F.coalesce(*(F.when(counts[f"n_{b}"] == top, F.lit(b)) for b in BASES))
    return F.when(top > 0, pick)


def minor_allele(counts: Column, major: Column) -> Column:
    """The last of the rarest alleles present other than the major one; C or A if there is none."""
    far = F.lit(1 << 60)
    seen = [F.when((counts[f"n_{b}"] > 0) & (major != b), counts[f"n_{b}"]).otherwise(far) for b in BASES]
    low = F.least(*seen)
    pick = F.coalesce(*(F.when((s == low) & (s < far), F.lit(b)) for b, s in reversed(list(zip(BASES, seen, strict=True)))))
    return F.when(major.isNotNull(), F.coalesce(pick, F.when(major == "A", F.lit("C")).otherwise(F.lit("A"))))


def additive(symbol: Column, major: Column, minor: Column) -> Column:
    """0, 1, 2 minor alleles; NULL with a missing or a third allele."""
    a, b = F.substring(symbol, 1, 1), F.substring(symbol, 2, 1)
    ok = a.isin(*BASES) & b.isin(*BASES) & ((a == major) | (a == minor)) & ((b == major) | (b == minor))
    return F.when(ok, (a == minor).cast("int") + (b == minor).cast("int"))


def maf(n_major: Column, n_minor: Column) -> Column:
    return F.try_divide(n_minor, n_minor + n_major)
