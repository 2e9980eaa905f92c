"""Vector and string helpers as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fsum(v: Column | str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return fsum(F.zip_with(a, b, lambda x, y: x * y))


def norm2(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def mean(v: Column | str) -> Column:
    return F.try_divide(fsum(v), F.size(v))


def sd(v: Column | str) -> Column:
    """Sample standard deviation (n - 1), two passes."""
    m = mean(v)
    return F.sqrt(F.try_divide(F.aggregate(v, F.struct(F.lit(0.0).alias("s"), m.alias("m")), lambda s, x: F.struct((s.s + (x - s.m) * (x - s.m)).alias("s"), s.m.alias("m")))["s"], F.size(v) - 1))


def axpy(a: float | Column, x: Column | str, y: Column | str) -> Column:
    return F.zip_with(x, y, lambda p, q: p * a + q)


def kronecker(a: Column | str, b: Column | str) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def hadamard(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def shifted(v: Column | str, by: int) -> Column:
    """v rotated to the right by `by` places."""
    n = F.size(v)
    return F.transform(v, lambda _, i: F.element_at(v, (F.pmod(i - by, n) + 1).cast("int")))


def permuted(v: Column | str, order: Column | str) -> Column:
    """v[order]; an index of -1 drops its place."""
    return F.transform(F.filter(order, lambda i: i >= 0), lambda i: F.element_at(v, (i + 1).cast("int")))


def powers(x: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.pow(x, k))


def running_sum(v: Column | str, block: int = 64) -> Column:
    """Sums of the elements up to each place.

    Elements are summed in blocks: within a block each place adds up its elements,
    and the blocks' totals are carried over blocks of blocks the same way, so the
    work per element is bounded by the block and the number of levels.
    """
    v = F.col(v) if isinstance(v, str) else v
    within = lambda a: F.transform(a, lambda _, i: fsum(F.slice(a, F.lit(1), i + 1)))
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / block).cast("int") - 1), lambda k: F.slice(a, k * block + 1, F.lit(block)))
    level = lambda a, carry: F.when(F.size(a) <= block, within(a)).otherwise(F.flatten(F.zip_with(cut(a), carry(F.transform(cut(a), fsum)), lambda x, total: F.transform(within(x), lambda s: s + total - fsum(x)))))
    return level(v, lambda t: level(t, lambda u: level(u, within)))


def first_index(needle: Column | str, hay: Column | str) -> Column:
    """0-based place of needle in hay, -1 if absent."""
    return (F.array_position(hay, needle) - 1).cast("int")


def match(x: Column | str, y: Column | str) -> Column:
    """Place in y of every element of x."""
    return F.transform(x, lambda e: first_index(e, y))


def run_index(v: Column | str) -> Column:
    """Index of the run of equal values that each element of a sorted array lies in."""
    distinct = F.array_distinct(v)
    return F.transform(v, lambda e: first_index(e, distinct))


# --- numbers and strings as the original tools read them ---


def num(c: Column | str) -> Column:
    """A text cell as a number; NULL (which drops the row in a filter) if it is none."""
    return F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double")


def position(c: Column | str) -> Column:
    """A text cell such as 1e6 as a position."""
    return num(c).cast("bigint")


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def trim_all(c: Column | str) -> Column:
    """Strip every character up to U+0020, not only blanks."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def index_of(s: Column | str, x: str) -> Column:
    return F.instr(s, x) - 1


def last_index_of(s: Column | str, x: str) -> Column:
    at = F.instr(F.reverse(s), x[::-1])
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(s) - len(x) - at + 1)


def replace_first(s: Column | str, pattern: str, new: str) -> Column:
    return F.regexp_replace(s, f"(?s)^(.*?)(?:{pattern})", f"$1{new}")


def full_match(s: Column | str, pattern: str) -> Column:
    return (F.col(s) if isinstance(s, str) else s).rlike(f"^(?:{pattern})$")


def split_overlap(a: Column | str, b: Column | str, pattern: str) -> Column:
    """Whether two delimited lists share an element; trailing empty parts do not count."""
    parts = lambda c: F.filter(F.split(c, pattern, -1), lambda x: x != "")
    return F.arrays_overlap(parts(a), parts(b))


def equal_precedence(first: Column, *rest: tuple[str, Column]) -> Column:
    """Left to right and/or/xor, all of one precedence."""
    for op, c in rest:
        first = (first & c) if op == "and" else (first | c) if op == "or" else (first != c)
    return first


def natural_key(c: Column | str, width: int = 20, ignore_case: bool = False) -> Column:
    """A sort key that orders the numbers inside a text by value; letters by lower case if ignore_case."""
    parts = F.regexp_extract_all(F.lower(c) if ignore_case else c, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def natural_order(c: Column | str, collation: str = "UNICODE", width: int = 20) -> Column:
    """natural_key whose text parts compare by a collation, as UNICODE_CI_AI: equal keys are ties of case and accents."""
    return F.collate(natural_key(c, width), collation)


def complement(x: Column | str) -> Column:
    """All bits turned, as the operator ~."""
    return F.bitwise_not(x)


def shifted_bits(x: Column | str, by: Column | int, unsigned: bool = False) -> Column:
    """x << by, or x >> -by for a negative `by` (>>> if unsigned); shifts count modulo the width, as the operators do."""
    by = F.lit(by) if isinstance(by, int) else by
    x = F.col(x) if isinstance(x, str) else x
    call = lambda name, n: F.call_function(name, x, n.cast("int"))
    return F.when(by >= 0, call("shiftleft", by)).otherwise(call("shiftrightunsigned" if unsigned else "shiftright", -by))
