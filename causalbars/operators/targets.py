"""Labels: what a forecast made at a bar's end will be judged by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeops import HOUR, exact_lead, with_halo

#: Hours of a chunk; chunks repeat as many rows as a label looks ahead.
CHUNK_HOURS = 30 * 24


def next_bar(bars: DataFrame, seconds: int = HOUR) -> DataFrame:
    """Return to the next bar, if the next row is exactly one interval later; else NULL."""

    def compute(b: DataFrame, by: tuple[str, ...]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("t")
        due = F.lead("t").over(w) == F.col("t") + seconds
        after = F.when(due, F.lead("close").over(w))
        return b.withColumns({"target_log_return": F.ln(after) - F.ln("close"), "target_close": after, "target_t": F.when(due, F.col("t") + seconds)})

    return with_halo(bars, 0, -(-seconds // HOUR), CHUNK_HOURS, compute)


def direct(bars: DataFrame, horizons: Sequence[int] = (4, 12, 24, 48, 720)) -> DataFrame:
    """Returns to exactly each horizon (hours) in one window pass; NULL where that bar is absent."""
    ahead = max(horizons)
    return with_halo(bars, 0, ahead, max(CHUNK_HOURS, 2 * ahead), lambda b, by: b.withColumns({f"target_log_return_{n}h": F.ln(exact_lead(F.col("close"), n, by)) - F.ln("close") for n in horizons}))


def with_target_quality(bars: DataFrame) -> DataFrame:
    """The next hour's quality, and whether both bars are whole."""
    found = with_halo(bars, 0, 1, CHUNK_HOURS, lambda b, by: b.withColumn("target_quality", exact_lead(F.col("quality"), 1, by)))
    return found.withColumn("strict", F.coalesce((F.col("quality") == "OK") & (F.col("target_quality") == "OK"), F.lit(False)))


def decision_clock(frame: DataFrame) -> DataFrame:
    """A bar starts at t, is known at t + 1 h, and its next-hour target closes at t + 2 h."""
    return frame.withColumns({"decision_t": F.col("t") + HOUR, "target_close_t": F.col("t") + 2 * HOUR})
