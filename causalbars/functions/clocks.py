"""Publication clocks: when a value that describes a day or week could first be known.

Calendars are computed by column expressions, so a calendar dimension is a projection of a date sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .timeops import epoch_seconds

NEW_YORK = "America/New_York"


def federal_holiday(day: Column) -> Column:
    """US federal holidays; fixed dates on a Saturday are observed on Friday, on a Sunday on Monday."""

    def fixed(d: Column) -> Column:
        m, n = F.month(d), F.dayofmonth(d)
        juneteenth = (m == 6) & (n == 19) & (F.year(d) >= 2021)
        return ((m == 1) & (n == 1)) | juneteenth | ((m == 7) & (n == 4)) | ((m == 11) & (n == 11)) | ((m == 12) & (n == 25))

    m, n, weekday = F.month(day), F.dayofmonth(day), F.weekday(day)
    week = F.ceil(n / 7)
    monday = (weekday == 0) & (((m == 1) & (week == 3)) | ((m == 2) & (week == 3)) | ((m == 5) & (n >= 25)) | ((m == 9) & (week == 1)) | ((m == 10) & (week == 2)))
    thanksgiving = (m == 11) & (weekday == 3) & (week == 4)
    observed = ((weekday == 4) & fixed(F.date_add(day, 1))) | ((weekday == 0) & fixed(F.date_sub(day, 1)))
    return fixed(day) | monday | thanksgiving | observed


def business_day(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~federal_holiday(day)


def local_time(day: Column, clock: str, zone: str = NEW_YORK) -> Column:
    """Seconds since 1970 of a wall-clock time on a day in a zone with daylight saving."""
    wall = F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(f" {clock}")))
    return epoch_seconds(F.convert_timezone(F.lit(zone), F.lit("UTC"), wall))


def calendar(spark: SparkSession, first: str, last: str, closures: tuple[str, ...] | DataFrame = ()) -> DataFrame:
    """day, is_business and next_business (the first business day after it) of each day; a small dimension.

    ``closures`` are exceptional days without business: texts, or a table with a column ``day``.
    """
    days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}' + INTERVAL 15 DAYS)) AS day")
    if isinstance(closures, DataFrame):
        days = days.join(closures.select("day", F.lit(True).alias("_shut")).distinct(), "day", "left")
    else:
        days = days.withColumn("_shut", F.col("day").cast("string").isin(*closures) if closures else F.lit(False))
    marked = days.withColumn("is_business", business_day(F.col("day")) & ~F.coalesce("_shut", F.lit(False))).drop("_shut")
    later = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(1, 14)  # a few thousand days at most
    following = F.min(F.when(F.col("is_business"), F.col("day"))).over(later)
    return marked.withColumn("next_business", following).where(F.col("day") <= F.lit(last).cast("date"))


def daily_release(day: Column, next_business: Column) -> Column:
    """Daily rates: 16:15 New York on the next business day."""
    return local_time(next_business, "16:15:00")


def close_release(day: Column) -> Column:
    """Index closes: 16:15 New York on the same day."""
    return local_time(day, "16:15:00")


def weekly_release(report: Column) -> Column:
    """Weekly positioning of a Tuesday: 15:30 New York on Friday, or on the next business day after it if a
    federal holiday falls on one of the days from Monday to Friday."""
    friday = F.date_add(report, 3)
    late = F.lit(False)
    for n in range(-1, 4):
        late = late | federal_holiday(F.date_add(report, n))
    nxt = F.date_add(report, 6)
    after = F.when(business_day(nxt), nxt).otherwise(F.date_add(nxt, 1))
    return local_time(F.when(late, after).otherwise(friday), "15:30:00")


def overridden(states: DataFrame, rule: Column, overrides: DataFrame, clock: str, day: str = "day") -> DataFrame:
    """``states`` with ``available``: the wall-clock time on the day that ``rule`` gives, or on the day that documented
    ``overrides`` (day, release_day, effective_t) put in its place, and ``overridden``.

    Of several overrides of a day the one that became effective last holds. An override without a release day
    withdraws earlier ones. No override may be before the day it is about.
    """
    latest = overrides.groupBy(F.col(day).alias("_day")).agg(F.max_by(F.struct("release_day"), "effective_t").alias("_o"))
    joined = states.join(latest, F.col(day) == F.col("_day"), "left")
    moved = F.col("_o.release_day")
    checked = F.when(moved < F.col(day), F.raise_error(F.lit("an override is before its day")).cast("date")).otherwise(F.coalesce(moved, rule))
    return joined.withColumns({"available": local_time(checked, clock), "overridden": moved.isNotNull()}).drop("_day", "_o")
