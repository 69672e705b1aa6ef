"""The semantics kernel: everything else builds on these window helpers.

Bars carry ``series`` and ``t``, the bar's start in seconds since 1970 (UTC). Lags are by the clock, never by
position; rolling windows cover ``(t - hours, t]`` and count only values that are present.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600
BY = ("series",)


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone (or one in a UTC session)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def bucket_start(t: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket that holds ``t``."""
    return (F.floor(t / seconds) * seconds).cast("long")


def clean(x: Column) -> Column:
    """NaN becomes NULL; infinities stay visible."""
    return F.when(~F.isnan(x), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def quotient(a: Column, b: Column) -> Column:
    """a / b with infinities, or NaN for 0 / 0, where b is zero."""
    at_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, at_zero).otherwise(ratio(a, b))


def ln(x: Column) -> Column:
    """The natural logarithm, minus infinity at zero; NULL below."""
    return F.when(x == 0, float("-inf")).otherwise(F.ln(x))


def _ordered(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy("t")


def exact_lag(x: Column, hours: int, by: Sequence[str] = BY) -> Column:
    """The value exactly ``hours`` earlier; NULL if that bar is absent."""
    return F.max(x).over(_ordered(by).rangeBetween(-hours * HOUR, -hours * HOUR))


def exact_lead(x: Column, hours: int, by: Sequence[str] = BY) -> Column:
    """The value exactly ``hours`` later; NULL if that bar is absent."""
    return F.max(x).over(_ordered(by).rangeBetween(hours * HOUR, hours * HOUR))


def rolling(agg: Callable[[Column], Column], x: Column, hours: int, least: int, by: Sequence[str] = BY) -> Column:
    """An aggregate over the last ``hours``; NULL below ``least`` present values."""
    w = _ordered(by).rangeBetween(-(hours * HOUR - 1), 0)
    return F.when(F.count(x).over(w) >= least, agg(x).over(w))


def rolling_corr(a: Column, b: Column, hours: int, least: int, by: Sequence[str] = BY) -> Column:
    """Correlation over pairs that are both present; NULL (no error) if either is constant."""
    w = _ordered(by).rangeBetween(-(hours * HOUR - 1), 0)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    value = F.try_divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w))
    return F.when(F.count(a).over(w) >= least, value)


def base_least(hours: int) -> int:
    return max(2, -(-hours // 2))


def cross_least(hours: int) -> int:
    return max(4, -(-hours // 2))


def positional(agg: Callable[[Column], Column], x: Column, rows: int, order: str = "t", by: Sequence[str] = BY) -> Column:
    """An aggregate over the last ``rows`` rows; NULL until all are there."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(w) == rows, agg(x).over(w))


def shift(x: Column, rows: int, order: str = "t", by: Sequence[str] = BY) -> Column:
    return F.lag(x, rows).over(Window.partitionBy(*by).orderBy(order))


def with_halo(bars: DataFrame, look_back: int, look_ahead: int, chunk_hours: int, compute: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """Computes bounded windows chunk by chunk, so one long series is many tasks.

    Rows within ``look_back`` hours before (``look_ahead`` after) a chunk are repeated into it, ``compute`` runs
    with ("series", "chunk") as its window keys, and repeated rows are dropped. Exact for every window that
    looks no farther.
    """
    size = chunk_hours * HOUR
    own = F.floor(F.col("t") / size)
    first, last = F.floor((F.col("t") - look_ahead * HOUR) / size), F.floor((F.col("t") + look_back * HOUR) / size)
    spread = bars.withColumn("_own", own).withColumn("chunk", F.explode(F.sequence(first, last)))
    done = compute(spread, ("series", "chunk"))
    return done.where(F.col("_own") == F.col("chunk")).drop("_own", "chunk")
