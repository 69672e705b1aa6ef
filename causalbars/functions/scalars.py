"""Scalar formulas shared by operators."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilograms to troy ounces (fixed value).
OUNCES_PER_KG = 32.15074656862798
WILSON_Z = 1.959963984540054


def bps(a: Column, b: Column) -> Column:
    return F.try_divide(a, b) * 10_000.0


def imbalance(bid: Column, ask: Column) -> Column:
    return F.when(bid + ask > 0, F.try_divide(bid - ask, bid + ask)).otherwise(0.0)


def wilson_lower(hits: Column, n: Column, z: float = WILSON_Z) -> Column:
    """Lower bound of the Wilson interval; NULL for no trials."""
    p = F.try_divide(hits, n)
    inner = p * (1 - p) / n + z * z / (4 * n * n)
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt(inner)) / (1 + z * z / n))


def direction(x: Column) -> Column:
    return F.when(x > 0, "UP").when(x < 0, "DOWN").when(x == 0, "FLAT")


def coverage_label(coverage: Column, only_trusted: Column) -> Column:
    """Quality of a bucket by coverage (0.9, 0.5) and by whether all samples were authenticated."""
    kind = F.when(only_trusted, "AUTHENTICATED").otherwise("MIXED")
    size = F.when(coverage >= 0.9, "FULL_COVERAGE").when(coverage >= 0.5, "PARTIAL_COVERAGE").otherwise("SPARSE_COVERAGE")
    return F.concat(size, F.lit("_"), kind)


def normal_cdf(x: float) -> float:
    """For one-row results on the driver: Spark has no built-in."""
    return NormalDist().cdf(x)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / (2 * F.pi()) ** 0.5


def normal_cdf_of(x: Column) -> Column:
    """The standard normal distribution function, to 1e-14: the density times the series x + x^3/3 + x^5/15 + ..."""
    near = F.greatest(F.lit(-9.0), F.least(F.lit(9.0), x))

    def term(acc: Column, k: Column) -> Column:
        following = acc["term"] * near * near / (2 * k + 1)
        return F.struct((acc["sum"] + following).alias("sum"), following.alias("term"))

    start = F.struct(near.cast("double").alias("sum"), near.cast("double").alias("term"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, term, lambda acc: acc["sum"])
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + normal_density(near) * series)))


def normal_quantile_of(p: Column) -> Column:
    """The inverse of :func:`normal_cdf_of` for 0 < p < 1 (NULL elsewhere): a rational start, then Newton's steps."""
    tail = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.ln(tail))
    rough = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    start = F.when(p < 0.5, -rough).otherwise(rough)
    found = F.aggregate(F.array(*[F.lit(i) for i in range(4)]), start, lambda x, _: x - (normal_cdf_of(x) - p) / normal_density(x))
    return F.when((p > 0) & (p < 1), found)
