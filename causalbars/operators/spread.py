"""Spread scenarios: what a forecast is worth after crossing a market's spread and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most assumptions, which every task gets.
MOST_ASSUMPTIONS = 1000


def spread_scenarios(forecasts: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Forecasts (series, t, mid, model, pred) under each assumption (name, spread, cost, wanted, step, top): margin
    of a long and a short position, the least quantity for the wanted profit (whole steps), and whether the best
    level could fill it. ``assumptions`` is a small table of the caller's: over MOST_ASSUMPTIONS rows are refused."""
    if assumptions.limit(MOST_ASSUMPTIONS + 1).count() > MOST_ASSUMPTIONS:
        raise ValueError(f"more than {MOST_ASSUMPTIONS} assumptions")
    both = forecasts.join(F.broadcast(assumptions), F.lit(True))
    bid, ask = F.col("mid") - F.col("spread") / 2, F.col("mid") + F.col("spread") / 2
    later = F.col("mid") * F.exp("pred")
    sides = F.explode(F.array(F.struct(F.lit("LONG").alias("side"), (later - F.col("spread") / 2 - ask - F.col("cost")).alias("margin")), F.struct(F.lit("SHORT").alias("side"), (bid - (later + F.col("spread") / 2) - F.col("cost")).alias("margin"))))
    done = both.withColumn("x", sides).select("series", "t", "model", "name", "wanted", "step", "top", "x.*")
    steps = F.ceil((F.col("wanted") / F.col("margin")).cast("decimal(30,9)") / F.col("step").cast("decimal(18,9)"))
    done = done.withColumn("quantity", F.when(F.round("margin", 6) > 0, F.greatest(steps, F.lit(1)).cast("double") * F.col("step")))
    return done.withColumns({"profit": F.col("quantity") * F.col("margin"), "fillable": F.coalesce(F.col("quantity") <= F.col("top"), F.lit(False))}).drop("wanted", "step", "top")
