"""Forward bars from quote samples: buckets, explicit gaps, admission, newest-bar forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import coverage_label
from ..functions.timeops import bucket_start

HORIZONS = {"4h": 14_400, "12h": 43_200, "1d": 86_400, "2d": 172_800, "30d": 2_592_000}
TRUSTED = "AUTHENTICATED_READ_ONLY"


def forward_bars(samples: DataFrame, horizons: dict[str, int] = HORIZONS, cadence: int = 60) -> DataFrame:
    """Epoch-aligned bars of quote samples (series, t, order_key, bid, ask, mode) for all horizons in one shuffle.

    Counts by mode are a map made in two map-side-combined steps.
    """
    exploded = samples.withColumn("h", F.explode(F.array(*[F.struct(F.lit(k).alias("horizon"), F.lit(s).alias("seconds")) for k, s in horizons.items()]))).select("*", "h.*").drop("h")
    mid, spread, order = (F.col("bid") + F.col("ask")) / 2, F.col("ask") - F.col("bid"), F.struct("t", "order_key")
    keyed = exploded.withColumns({"bucket": (F.floor(F.col("t") / F.col("seconds")) * F.col("seconds")).cast("long"), "mid": mid, "spread": spread})
    keys = ["series", "horizon", "seconds", "bucket"]
    by_mode = keyed.groupBy(*keys, "mode").agg(
        F.count("*").alias("n"), F.min_by(F.struct("mid", "bid", "ask"), order).alias("first"), F.min(order).alias("at0"), F.max_by(F.struct("mid", "bid", "ask", "spread"), order).alias("last"), F.max(order).alias("at1"),
        F.max("mid").alias("high"), F.min("mid").alias("low"), F.sum("spread").alias("spreads"), F.max("spread").alias("widest"),
    )
    done = by_mode.groupBy(*keys).agg(
        F.sum("n").alias("snapshot_count"), F.min_by("first", "at0").alias("_f"), F.max_by("last", "at1").alias("_l"), F.max("high").alias("high"), F.min("low").alias("low"), (F.sum("spreads") / F.sum("n")).alias("mean_spread"),
        F.max("widest").alias("max_spread"), F.min("at0.t").alias("first_t"), F.max("at1.t").alias("last_t"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "n")))).alias("mode_counts"),
    )
    expected = F.ceil(F.col("seconds") / cadence)
    done = done.withColumns({"expected": expected, "coverage": F.least(F.lit(1.0), F.col("snapshot_count") / expected)})
    trusted = F.array_join(F.map_keys("mode_counts"), ",") == TRUSTED
    return done.select("series", "horizon", "bucket", (F.col("bucket") + F.col("seconds")).alias("bucket_end"), "snapshot_count", "expected", "coverage", F.col("_f.mid").alias("open"), "high", "low", F.col("_l.mid").alias("close"), F.col("_f.bid").alias("open_bid"), F.col("_f.ask").alias("open_ask"), F.col("_l.bid").alias("close_bid"), F.col("_l.ask").alias("close_ask"), F.col("_l.spread").alias("close_spread"), "mean_spread", "max_spread", "first_t", "last_t", "mode_counts", coverage_label(F.col("coverage"), trusted).alias("quality"))


def assessments(samples: DataFrame, as_of: int, delay: int = 120, horizons: dict[str, int] = HORIZONS, least: int = 2, most: int = 512, cadence: int = 60, assessed: DataFrame | None = None) -> DataFrame:
    """A bar or an explicit gap for each bucket from a series' first sample to the last bucket that is closed.

    A bucket is closed once ``as_of - delay`` has passed its end. Empty buckets and those under ``least`` samples
    are gaps. At most ``most`` buckets a series and horizon are assessed in one catch-up, oldest first. With
    ``assessed`` (what earlier catch-ups returned) each series and horizon goes on at its last assessed end: nothing is
    assessed twice, and samples that came late for an assessed bucket change nothing.
    """
    firsts = samples.groupBy("series").agg(F.min("t").alias("_first"))
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("horizon"), F.lit(s).alias("seconds")) for k, s in horizons.items()]))
    plan = firsts.withColumn("h", table).select("series", "_first", "h.*")
    start = F.floor(F.col("_first") / F.col("seconds")) * F.col("seconds")
    if assessed is not None:
        ends = assessed.groupBy("series", "horizon").agg(F.max("bucket_end").alias("_end"))
        plan = plan.join(ends, ["series", "horizon"], "left")
        start = F.coalesce(F.col("_end"), start)
        from_t = plan.groupBy("series").agg(F.min(start).alias("_from"))  # what no horizon needs is not binned again
        samples = samples.join(from_t, "series").where("t >= _from").drop("_from")
    bars = forward_bars(samples.where(F.col("t") < as_of), horizons, cadence)
    closed = F.floor((F.lit(as_of) - delay) / F.col("seconds")) * F.col("seconds")
    last = F.least(closed - F.col("seconds"), start + F.col("seconds") * (most - 1))
    spine = plan.where(last >= start).select("series", "horizon", "seconds", F.explode(F.sequence(start.cast("long"), last.cast("long"), F.col("seconds").cast("long"))).alias("bucket"))
    joined = spine.join(bars, ["series", "horizon", "bucket"], "left")
    count = F.coalesce("snapshot_count", F.lit(0))
    return joined.withColumns({"status": F.when(count >= least, "BAR_MATERIALIZED").otherwise("GAP_RECORDED"), "snapshot_count": count, "bucket_end": F.col("bucket") + F.col("seconds")}).drop("seconds")


def gap_reason(status: Column, count: Column) -> Column:
    """Why a bucket is a gap; NULL for bars."""
    return F.when(status == "GAP_RECORDED", F.when(count == 0, "NO_OBSERVED_SNAPSHOTS").otherwise("INSUFFICIENT_OBSERVED_SNAPSHOTS"))


def admission(bars: DataFrame, least_coverage: float = 0.9, mode: str = TRUSTED) -> DataFrame:
    """Whether a bar may be forecast from, with the first reason against it by priority."""
    modes = F.map_keys("mode_counts")
    reason = (
        F.when(F.col("snapshot_count") < 2, "INSUFFICIENT_SAMPLES").when(F.col("snapshot_count") > F.col("expected"), "MORE_SAMPLES_THAN_EXPECTED")
        .when(F.aggregate(F.map_values("mode_counts"), F.lit(0).cast("long"), lambda a, x: a + x) != F.col("snapshot_count"), "COUNTS_DISAGREE")
        .when(~((F.size(modes) == 1) & F.array_contains(modes, mode)), "UNTRUSTED_MODE").when(F.col("coverage") < least_coverage, "LOW_COVERAGE")
    )
    return bars.withColumns({"admitted": reason.isNull(), "reason": F.coalesce(reason, F.lit("ADMITTED"))})


def newest_forecasts(assessed: DataFrame, least_coverage: float) -> DataFrame:
    """A baseline forecast from the newest assessment of each series and horizon; a newer gap or a rejected newest
    bar blocks older ones."""
    newest = assessed.groupBy("series", "horizon").agg(F.max_by(F.struct("bucket", "bucket_end", "status", "close", "coverage"), "bucket_end").alias("a")).select("series", "horizon", "a.*")
    status = F.when(F.col("status") == "GAP_RECORDED", "BLOCKED_BY_GAP").when(F.col("coverage") < least_coverage, "BLOCKED_BY_ADMISSION").otherwise("FORECAST")
    issued = F.col("forecast_status") == "FORECAST"
    return newest.withColumn("forecast_status", status).withColumns({"forecast_return": F.when(issued, 0.0), "forecast_price": F.when(issued, F.col("close")), "direction": F.when(issued, "FLAT")}).drop("status")


def roll_up(assessed: DataFrame) -> DataFrame:
    """Bars, gaps and the last assessed end of each horizon."""
    return assessed.groupBy("horizon").agg(F.sum((F.col("status") == "BAR_MATERIALIZED").cast("int")).alias("bars"), F.sum((F.col("status") == "GAP_RECORDED").cast("int")).alias("gaps"), F.max("bucket_end").alias("last_end"))


def latest(rows: DataFrame, by: Sequence[str], n: int, order: str = "t") -> DataFrame:
    """The latest n rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def bucket_of(t, seconds: int):
    return bucket_start(F.col(t), seconds)
