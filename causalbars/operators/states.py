"""Published states: as-of joins and features at release cadence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeops import HOUR, positional, ratio, shift

#: Seconds of the time buckets in which queries meet states.
BUCKET = 86_400


def asof_intervals(queries: DataFrame, states: DataFrame, at: str) -> DataFrame:
    """Joins each query to the latest state with ``available <= at``, for one global series of states.

    Queries and states are keyed by time buckets; each bucket also gets the last state of the buckets before it, from
    a table with one row a bucket. So one shuffle on the bucket serves any number of states, and no query meets more
    than the states of its bucket.
    """
    values = states.columns
    asked = queries.withColumn("_bucket", F.floor(F.col(at) / BUCKET))
    stated = states.withColumn("_bucket", F.floor(F.col("available") / BUCKET))
    last = stated.groupBy("_bucket").agg(F.max_by(F.struct(*values), "available").alias("_last"))
    buckets = asked.select("_bucket").distinct().join(last, "_bucket", "full")
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))  # one row a day
    carried = buckets.select("_bucket", before.alias("_s")).where("_s IS NOT NULL").select(*[F.col(f"_s.{x}").alias(x) for x in values], "_bucket")
    return asof_by_key(asked, stated.unionByName(carried), at, "_bucket").drop("_bucket")


def asof_by_key(queries: DataFrame, states: DataFrame, at: str, key: str) -> DataFrame:
    """The same for keyed states of any size: one shuffle on the key, the last whole state row carried forward.

    The state is carried as one struct, so a NULL in it is not filled from an older state.
    """
    values = [x for x in states.columns if x != key]
    stated = states.select(key, F.col("available").alias("_at"), F.lit(0).alias("_query"), F.struct(*values).alias("_state"))
    asked = queries.select(key, F.col(at).alias("_at"), F.lit(1).alias("_query"), F.struct(*queries.columns).alias("_row"))
    w = Window.partitionBy(key).orderBy("_at", "_query").rowsBetween(Window.unboundedPreceding, 0)
    both = stated.unionByName(asked, allowMissingColumns=True).withColumn("_state", F.last("_state", ignorenulls=True).over(w))
    return both.where("_query = 1").select("_row.*", *[F.col(f"_state.{x}").alias(x) for x in values]).withColumn("age_hours", (F.col(at) - F.col("available")) / HOUR)


def state_flags(frame: DataFrame, prefix: str) -> DataFrame:
    """Whether a state was published, its age, and whether it is at most an hour old."""
    age = F.col("age_hours")
    return frame.withColumns({f"{prefix}_has_published_state": F.col("available").isNotNull().cast("int"), f"{prefix}_publication_age_hours": age, f"{prefix}_new_within_1h": F.coalesce(age.between(0, 1), F.lit(False)).cast("int")}).drop("age_hours")


def _zscore(x: Column, rows: int, order: str, by: Sequence[str]) -> Column:
    mean, std = (positional(f, x, rows, order, by) for f in (F.avg, F.stddev_pop))
    return ratio(x - mean, std)


def rate_features(states: DataFrame, short: str, long: str, order: str = "observed", by: Sequence[str] = ("series",), horizons=(1, 5, 20), windows=(5, 20)) -> DataFrame:
    """Levels, curve, changes over releases, and volatility of one-release changes."""
    named = {"short": F.col(short), "long": F.col(long), "curve": F.col(long) - F.col(short)}
    changes = {f"{n}_change_{k}release": x - shift(x, k, order, by) for k in horizons for n, x in named.items()}
    done = states.withColumns({**named, **changes, **{f"_{n}": x - shift(x, 1, order, by) for n, x in named.items()}})
    vols = {f"{n}_change_vol_{w}release": positional(F.stddev_pop, F.col(f"_{n}"), w, order, by) for w in windows for n in named}
    return done.withColumns(vols).drop(*[f"_{n}" for n in named])


def index_features(states: DataFrame, order: str = "observed", by: Sequence[str] = ("series",), horizons=(1, 5, 20), windows=(5, 20, 60)) -> DataFrame:
    """Daily index: candle, returns over releases, volatility, distance to mean, z-score, place in range."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    done = states.withColumn("_r", F.ln(c) - shift(F.ln(c), 1, order, by))
    named = {"daily_range_pct": ratio(h - l, o), "daily_body_pct": ratio(c - o, o), "close_location": F.coalesce(ratio(c - l, h - l), F.lit(0.5))}
    named |= {f"log_return_{k}release": F.ln(c) - shift(F.ln(c), k, order, by) for k in horizons}
    for w in windows:
        low, high, mean = (positional(f, c, w, order, by) for f in (F.min, F.max, F.avg))
        named |= {f"return_vol_{w}release": positional(F.stddev_pop, F.col("_r"), w, order, by), f"close_vs_sma_{w}release": ratio(c, mean) - 1, f"zscore_{w}release": _zscore(c, w, order, by), f"range_position_{w}release": F.coalesce(ratio(c - low, high - low), F.lit(0.5))}
    return done.withColumns(named).drop("_r")


def positioning_features(states: DataFrame, order: str = "observed", by: Sequence[str] = ("series",), horizons=(1, 4, 13), windows=(13, 26, 52)) -> DataFrame:
    """Weekly positions (long, short and spread of holder groups) relative to open interest."""
    oi = F.col("open_interest")
    net = {g: F.col(f"{g}_long") - F.col(f"{g}_short") for g in ("managed", "producer", "swap", "other", "nonreportable")}
    named = {f"{g}_net_oi": ratio(x, oi) for g, x in net.items()}
    named |= {f"{g}_net_contracts": net[g] for g in ("managed", "producer", "swap")}
    named |= {f"{g}_gross_oi": ratio(F.col(f"{g}_long") + F.col(f"{g}_short"), oi) for g in ("managed", "producer", "swap")}
    named |= {f"{g}_spread_oi": ratio(F.col(f"{g}_spread"), oi) for g in ("managed", "swap")}
    done = states.withColumns(named).withColumn("divergence", F.col("managed_net_oi") - F.col("producer_net_oi"))
    moving = {x: F.col(x) for x in ("managed_net_oi", "producer_net_oi", "swap_net_oi", "divergence")}
    later = {f"open_interest_change_{k}release_pct": ratio(oi, shift(oi, k, order, by)) - 1 for k in horizons}
    later |= {f"{n}_change_{k}release": x - shift(x, k, order, by) for k in horizons for n, x in moving.items()}
    scored = {"open_interest": oi} | {n: moving[n] for n in ("managed_net_oi", "producer_net_oi", "divergence")}
    later |= {f"{n}_zscore_{w}release": _zscore(x, w, order, by) for w in windows for n, x in scored.items()}
    return done.withColumns(later)
