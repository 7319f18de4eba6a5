"""Measurement vectors as array columns: rounding, hashes, containment, ratios.

All functions take and give Columns and stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), value worked out once a row: inside a lambda it would be for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def rounded(values: Column, decimals: int = 6) -> Column:
    """Sorted ascending and rounded half to even."""
    return F.sort_array(F.transform(values, lambda x: F.bround(x, decimals)))


def value_hash(values: Column, decimals: int = 6) -> Column:
    """16 hex digits that equal vectors share: SHA-256 of the sorted values in fixed notation."""
    text = F.array_join(F.transform(F.sort_array(values), lambda x: F.format_string(f"%.{decimals}f", x)), ",")
    return F.substring(F.sha2(text, 256), 1, 16)


def jaccard(a: Column, b: Column) -> Column:
    """Of the value sets; 1 if both are empty, 0 if one is."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def is_subset(a: Column, b: Column) -> Column:
    """All values of one of the vectors occur in the other; empty vectors are no subsets."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def is_endpoint_dropout(a: Column, b: Column, shortest: int = 3) -> Column:
    """The shorter sorted vector is the longer one without some of its first or last values."""
    short = F.when(F.size(a) < F.size(b), a).otherwise(b)
    long = F.when(F.size(a) < F.size(b), b).otherwise(a)
    shifts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(long) - F.size(short)))
    return (F.size(a) != F.size(b)) & (F.size(short) >= shortest) & F.exists(shifts, lambda i: F.slice(long, i + 1, F.size(short)) == short)


def share_kind(a: Column, b: Column) -> Column:
    """How two sorted vectors share values: exact, endpoint_dropout, subset, high_jaccard or null, the first that holds."""
    n = F.least(F.size(a), F.size(b))
    return (
        F.when(a == b, "exact")
        .when(is_endpoint_dropout(a, b), "endpoint_dropout")
        .when((n >= 4) & is_subset(a, b), "subset")
        .when((n >= 5) & (jaccard(a, b) >= 0.95), "high_jaccard")
    )


def _magnitude(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x))


def integer_ratio(a: Column, b: Column, most: int = 100, rel: float = 1e-6) -> Column:
    """The whole number k in 2..most by which each rank of one vector is the other's, else null. Ranks with 0 on both sides do not count."""
    base = F.when(_magnitude(a) <= _magnitude(b), a).otherwise(b)
    top = F.when(_magnitude(a) <= _magnitude(b), b).otherwise(a)
    ranks = F.filter(F.arrays_zip(base.alias("x"), top.alias("y")), lambda p: (p["x"] != 0) | (p["y"] != 0))
    ratios = F.transform(ranks, lambda p: F.try_divide(p["y"], p["x"]))
    middle = lambda o: F.try_element_at(o, (F.floor(F.size(o) / 2) + 1).cast("int"))

    def whole(ratios: Column, middle: Column) -> Column:
        k = F.round(middle)
        fits = F.forall(ratios, lambda r: F.coalesce(F.abs(r - k) <= rel * k, F.lit(False)))
        return F.when((F.size(ratios) > 0) & (middle >= 1.5) & (k >= 2) & (k <= most) & fits, k.cast("long"))

    found = let(F.sort_array(ratios), lambda o: let(middle(o), lambda m: whole(o, m)))
    return F.when((F.size(a) == F.size(b)) & (a != b), found)


def multiset_hits(a: Column, b: Column) -> Column:
    """Size of the intersection in which repeated values count as often as both hold them."""
    count = lambda v, x: F.size(F.filter(v, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def z_similarity(a: Column, b: Column) -> Column:
    """1 - mean distance of ranked z-scores (population SD) / 2, for vectors of at least 4 values with lengths at most 2 apart; else 0."""
    n = F.least(F.size(a), F.size(b))

    def z(v: Column) -> Column:
        head = F.slice(F.sort_array(v), F.lit(1), F.greatest(n, F.lit(1)))
        size = F.greatest(F.least(F.size(v), n), F.lit(1))
        mean = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x) / size
        sd = lambda h, m: F.sqrt(F.aggregate(h, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / size)
        scores = lambda h, m, d: F.transform(h, lambda x: F.when(d > 0, (x - m) / d).otherwise(F.lit(0.0)))
        return let(head, lambda h: let(mean(h), lambda m: let(sd(h, m), lambda d: scores(h, m, d))))

    gap = F.aggregate(F.zip_with(z(a), z(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.greatest(n, F.lit(1))
    return F.when((n >= 4) & (F.abs(F.size(a) - F.size(b)) <= 2), F.greatest(F.lit(0.0), 1 - gap / 2)).otherwise(F.lit(0.0))


def repeating_fraction(v: Column, tolerance: Column) -> Column:
    """The smallest q >= 3, no product of twos and fives, for which some p / q prints as v; null if v is whole or no q fits.

    q stays below the bound at which a fit would be chance: sqrt(0.02 / (0.6 * tolerance)), 1000 at most.
    """
    bound = F.least(F.lit(1000), F.floor(F.sqrt(F.lit(0.02) / (0.6 * tolerance))).cast("int"))
    plain = F.array(*[F.lit(2**i * 5**j) for i in range(10) for j in range(5) if 2**i * 5**j <= 1000])
    qs = F.filter(F.sequence(F.lit(3), F.greatest(F.lit(3), bound)), lambda q: ~F.array_contains(plain, q))
    fits = F.filter(qs, lambda q: F.abs(v - F.round(v * q) / q) <= tolerance)
    return F.when((v != F.floor(v)) & (bound >= 3), F.try_element_at(fits, F.lit(1)))
