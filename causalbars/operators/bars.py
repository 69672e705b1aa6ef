"""Building, repairing and checking bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeops import HOUR, bucket_start

OHLC = ("open", "high", "low", "close")


def tick_bars(ticks: DataFrame, seconds: int = HOUR) -> DataFrame:
    """OHLC bars of ticks (series, t, order_key, price): one shuffle with map-side combination."""
    order = F.struct("t", "order_key")
    return ticks.withColumn("bar", bucket_start(F.col("t"), seconds)).groupBy("series", F.col("bar")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("n_ticks"),
    ).withColumnRenamed("bar", "t")


def valid_ohlc(prefix: str = "") -> Column:
    """Finite, positive and in order: high is the greatest, low the least."""
    o, h, l, c = (F.col(prefix + x) for x in OHLC)
    ordered = (h >= F.greatest(o, c)) & (l <= F.least(o, c)) & (h >= l) & (l > 0)
    finite = F.lit(True)
    for x in (o, h, l, c):
        finite = finite & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(finite & ordered, F.lit(False))


def suspicious_hours(minutes: DataFrame, most: int = 60) -> DataFrame:
    """(series, hour) with the reasons to distrust an hour of minute rows.

    conflict: two different rows for one minute; invalid: a row fails :func:`valid_ohlc`; overfull: more raw rows
    than ``most``; reversal: a row is earlier than its predecessor in the archive (both rows' hours).
    """
    hour = bucket_start(F.col("t"), HOUR)
    rows = minutes.withColumn("hour", hour).withColumn("ok", valid_ohlc())
    per_minute = rows.groupBy("series", "hour", "t").agg(F.count_distinct(F.struct(*OHLC)).alias("versions"), F.count("*").alias("n"), F.min("ok").alias("ok"))
    by_hour = per_minute.groupBy("series", "hour").agg(F.max(F.col("versions") > 1).alias("conflict"), F.max(~F.col("ok")).alias("invalid"), (F.sum("n") > most).alias("overfull"))
    before = F.lag("t").over(Window.partitionBy("series", "archive").orderBy("row_no"))
    turned = minutes.withColumn("before", before).where("before > t").select("series", F.explode(F.array(hour, bucket_start(F.col("before"), HOUR))).alias("hour")).distinct()
    flagged = by_hour.join(turned.withColumn("reversal", F.lit(True)), ["series", "hour"], "full")
    for c in ("conflict", "invalid", "overfull", "reversal"):
        flagged = flagged.withColumn(c, F.coalesce(c, F.lit(False)))
    return flagged.where("conflict OR invalid OR overfull OR reversal")


def conservative_bars(minutes: DataFrame, full: int = 60, most: int = 60) -> DataFrame:
    """Hourly bars of minute rows (series, archive, row_no, t, OHLC) without the suspicious hours.

    Identical minutes count once, the first by archive and row; quality is OK only with ``full`` minutes.
    """
    rows = minutes.withColumn("hour", bucket_start(F.col("t"), HOUR))
    trusted = rows.join(suspicious_hours(minutes, most).select("series", "hour"), ["series", "hour"], "left_anti")
    single = trusted.groupBy("series", "hour", "t").agg(F.min_by(F.struct(*OHLC), F.struct("archive", "row_no")).alias("m"))
    bars = single.groupBy("series", "hour").agg(
        F.min_by("m.open", "t").alias("open"), F.max("m.high").alias("high"), F.min("m.low").alias("low"), F.max_by("m.close", "t").alias("close"), F.count("*").alias("minute_count"),
    )
    return bars.withColumnRenamed("hour", "t").withColumn("quality", F.when(F.col("minute_count") >= full, "OK").otherwise("PARTIAL_SOURCE_HOUR"))


def aggregation_report(minutes: DataFrame, full: int = 60, most: int = 60) -> DataFrame:
    """One row of counters about a build of bars."""
    hour = bucket_start(F.col("t"), HOUR)
    raw = minutes.agg(F.count("*").alias("raw_rows"), F.count_distinct("series", hour).alias("raw_hours"), F.sum((~valid_ohlc()).cast("int")).alias("invalid_rows"))
    bad = suspicious_hours(minutes, most).agg(F.count("*").alias("suspicious_hours"), *[F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).alias(f"{c}_hours") for c in ("conflict", "overfull", "reversal")])
    built = conservative_bars(minutes, full, most).agg(F.count("*").alias("bars"), F.coalesce(F.sum((F.col("quality") == "OK").cast("int")), F.lit(0)).alias("full_bars"), F.coalesce(F.sum("minute_count"), F.lit(0)).alias("used_minutes"))
    return raw.join(bad, F.lit(True)).join(built, F.lit(True))  # three one-row tables


def stitch(fragments: DataFrame) -> DataFrame:
    """Joins overlapping fragments of bars (series, t, archive, OHLC): bars on which archives differ are dropped,
    identical ones are kept once, from the first archive."""
    values = F.struct(*OHLC)
    return fragments.groupBy("series", "t").agg(F.count_distinct(values).alias("versions"), F.min_by(values, "archive").alias("v"), F.min("archive").alias("archive")).where("versions = 1").select("series", "t", "archive", "v.*")


def fragment_bars(minutes: DataFrame) -> DataFrame:
    """Bars of each archive by itself: the archive is one more key, not a loop."""
    keyed = minutes.withColumn("series", F.struct("series", "archive"))
    return conservative_bars(keyed).select("series.series", F.col("series.archive").alias("archive"), "t", *OHLC)


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: one map-side-combined aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def release_bundles(states: DataFrame) -> DataFrame:
    """One row a publication instant: its latest observation and how many were published together."""
    rest = [c for c in states.columns if c != "available"]
    return states.groupBy("available").agg(F.max_by(F.struct(*rest), "observed").alias("_s"), F.count("*").alias("bundle_size")).select("available", "_s.*", "bundle_size")


def validation_report(bars: DataFrame) -> DataFrame:
    """One row a series: rows, duplicate times, off-hour times, invalid rows, first and last time."""
    per_t = bars.groupBy("series", "t").agg(F.count("*").alias("n"), F.sum((~valid_ohlc()).cast("int")).alias("bad"))
    return per_t.groupBy("series").agg(
        F.sum("n").alias("rows"), F.sum((F.col("n") > 1).cast("int")).alias("duplicate_times"), F.sum((F.col("t") % HOUR != 0).cast("int")).alias("off_hour_times"),
        F.sum("bad").alias("invalid_rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
    )


def require_valid(bars: DataFrame) -> DataFrame:
    """``bars`` themselves; raises ValueError if the report finds a fault or there are none."""
    bad = validation_report(bars).agg(F.count("*").alias("n"), F.sum(F.col("duplicate_times") + F.col("off_hour_times") + F.col("invalid_rows")).alias("faults")).first()
    if not bad["n"] or bad["faults"]:
        raise ValueError(f"bars are empty or have {bad['faults']} faults")
    return bars
