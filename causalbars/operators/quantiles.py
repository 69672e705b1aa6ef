"""Exact quantiles and ranks of groups of any size: no group's values meet in one buffer, task or window.

A quantile is bracketed by mergeable sketches, round by round, until few values are left between the brackets; these
are counted by value (copies are combined before the shuffle) and the wanted places are read off their running counts.
The sketches only steer: places outside a bracket are noticed by counting, never guessed. Ranks come from the
running counts of distinct values inside value ranges, moved on by the counts of lower ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written

#: Rows between two brackets that need no further round.
FEW = 1 << 16
#: Marks of a sketch, and its accuracy (1 / relative rank error).
MARKS, ACCURACY = 500, 10_000


def _same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys match; the right side's keys go."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, cond, how).drop(*(f"_r_{c}" for c in on))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], few: int = FEW) -> DataFrame:
    """(by, probability, quantile): exact, interpolated between neighbours as ``percentile`` does; nulls do not count, and a
    group without values has no rows. Null keys are groups of their own."""
    by = list(by)
    values = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in dict.fromkeys(probabilities)]))
    sizes = values.groupBy(*by).agg(F.count("*").alias("_m"))
    keys = [*by, "probability"]
    brackets = sizes.withColumn("probability", wanted).withColumn("_at", F.col("probability") * (F.col("_m") - 1))
    brackets = brackets.select(*keys, "_at", "_m", F.lit(float("-inf")).alias("_lo"), F.lit(float("nan")).alias("_hi"))  # NaN sorts last
    marks = [i / MARKS for i in range(MARKS + 1)]
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    while True:
        placed = _same(values, brackets, by)
        most = brackets.where("_lo < _hi").agg(F.max("_m")).first()[0] or 0  # one number
        if most <= few:
            break
        sketch = placed.where(inside).groupBy(*keys).agg(F.percentile_approx("_v", F.array(*map(F.lit, marks)), ACCURACY).alias("_marks"))
        below = placed.groupBy(*keys).agg(F.sum((F.col("_v") < F.col("_lo")).cast("long")).alias("_below"))
        joined = _same(_same(brackets, sketch, keys), below, keys)
        place = (F.col("_at") - F.col("_below")) / F.col("_m") * MARKS
        low, high = F.get("_marks", (F.floor(place) - 2).cast("int")), F.get("_marks", (F.ceil(place) + 2).cast("int"))
        tight = joined.select(*keys, "_at", F.col("_lo").alias("_lo0"), F.col("_hi").alias("_hi0"), F.coalesce(low, "_lo").alias("_lo"), F.coalesce(high, "_hi").alias("_hi"), F.col("_m").alias("_m0"))
        counted = _same(values, tight, by).groupBy(*keys).agg(F.sum((F.col("_v") < F.col("_lo")).cast("long")).alias("_b"), F.sum(inside.cast("long")).alias("_m"))
        checked = _same(tight, counted, keys)
        holds = (F.col("_b") <= F.floor("_at")) & (F.ceil("_at") < F.col("_b") + F.col("_m"))
        after = checked.select(*keys, "_at", F.when(holds, F.col("_m")).otherwise(F.col("_m0")).alias("_m"), *[F.when(holds, F.col(c)).otherwise(F.col(f"{c}0")).alias(c) for c in ("_lo", "_hi")])
        brackets = written(after, "brackets")  # a row a group and probability
        if (brackets.where("_lo < _hi").agg(F.max("_m")).first()[0] or 0) >= most:
            break  # a value with a great share of the rows: its copies are combined below
    spot = F.when(F.col("_v") < F.col("_lo"), F.lit(None)).otherwise(F.col("_v"))  # all lower values are one
    counts = placed.where(F.col("_v") <= F.col("_hi")).groupBy(*keys, "_at", spot.alias("_v")).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ran = counts.withColumn("_end", F.sum("_n").over(order))
    pick = lambda at: F.max(F.when((F.col("_end") - F.col("_n") <= at) & (at < F.col("_end")), F.col("_v")))
    found = ran.groupBy(*keys, "_at").agg(pick(F.floor("_at")).alias("_a"), pick(F.ceil("_at")).alias("_b"))
    share = F.col("_at") - F.floor("_at")
    between = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") * (1 - share) + F.col("_b") * share)
    return found.select(*keys, between.alias("quantile"))


def quantile_columns(rows: DataFrame, by: Sequence[str], value: str, named: dict[str, float], few: int = FEW) -> DataFrame:
    """One row a group with a column for each named probability."""
    found = quantiles(rows, by, value, list(named.values()), few)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("probability") == float(p), F.col("quantile"))).alias(n) for n, p in named.items()])


def column_quantiles(rows: DataFrame, columns: Sequence[str], probability: float, few: int = FEW) -> DataFrame:
    """(column, quantile) of several columns of the whole table; columns without values have no row."""
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    return quantiles(rows.select(listed.alias("x")).select("x.*"), ["column"], "v", [probability], few).select("column", "quantile")


def ranks(rows: DataFrame, by: Sequence[str], column: str, name: str) -> DataFrame:
    """Adds ``name``: the rank of ``column`` within ``by``, from 1, ties at their average, nulls first."""
    by = list(by)
    counts = rows.groupBy(*by, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))  # copies meet before the shuffle
    marks = F.percentile_approx("_v", F.array(*[F.lit(i / MARKS) for i in range(1, MARKS)]), ACCURACY)
    bounds = counts.groupBy(*by).agg(F.coalesce(marks, F.array().cast("array<double>")).alias("_marks"))
    part = F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_marks", lambda m: m < F.col("_v"))))
    placed = _same(counts, bounds, by).withColumn("_part", part).drop("_marks")
    sizes = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_before"))  # MARKS rows a group at most
    end = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = _same(placed.withColumn("_end", end), sizes, [*by, "_part"])
    ranked = ranked.select(*by, "_v", (F.col("_before") + F.col("_end") - (F.col("_n") - 1) / 2.0).alias(name))
    return _same(rows.withColumn("_v", F.col(column)), ranked, [*by, "_v"]).drop("_v")
