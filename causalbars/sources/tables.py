"""Adapters from the event, order and line-item tables to ticks, minutes, bars, books and published states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeops import HOUR, bucket_start, epoch_seconds
from ..operators.bars import tick_bars

#: Days by which order dates are moved, so that states overlap the events of January 2024.
SHIFT_DAYS = 8228


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, t (seconds), order_key, price, user_id: one row an event."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("series"), epoch_seconds("ts").alias("t"), F.col("event_id").alias("order_key"), F.col("value").alias("price"), "user_id")


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute rows with lineage: archive, row_no; some rows stand out of order in their archive."""
    row_no = F.col("order_key") * 2 + F.when(F.col("order_key") % 501 == 0, 7).otherwise(0)
    return ticks(spark, sf_dir).select("series", (F.col("user_id") % 3).alias("archive"), row_no.alias("row_no"), bucket_start(F.col("t"), 60).alias("t"), F.col("price").alias("open"), (F.col("price") + 0.5).alias("high"), (F.col("price") - F.least(F.lit(0.5), F.col("price") / 2)).alias("low"), F.col("price").alias("close"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type."""
    return tick_bars(ticks(spark, sf_dir), HOUR)


def day_of(column: str, shift: int = SHIFT_DAYS):
    return F.date_add(F.col(column).cast("date"), shift)
