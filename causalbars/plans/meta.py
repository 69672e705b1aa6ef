"""Models of models over out-of-fold predictions: stacking, selective prediction, regime specialists.

Input is the long table of :func:`walk_forward.ridge_walk_forward` (series, model, fold, t, close, actual, pred).
What is chosen for a fold uses earlier folds only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import wilson_lower
from ..operators import linear, quantiles


def _expanding(cells: DataFrame, features: Sequence[str], alpha: float, keys: Sequence[str], least: int) -> DataFrame:
    """(keys, fold, offset, weights) of ridges for each fold from the sums of earlier folds, solved on the executors."""
    return linear.solve_groups(cells, [*keys, "fold"], {"ridge": features}, "actual", alpha, "fold", least).drop("model", "n")


def _score(frame: DataFrame, table: DataFrame, features: Sequence[str], on: list[str]) -> DataFrame:
    return frame.join(table, on, "left").withColumn("pred", F.col("offset") + linear.dot(sorted(features), "weights")).drop("offset", "weights")


def stack(predictions: DataFrame, models: Sequence[str], alpha: float = 1.0, least: int = 50) -> DataFrame:
    """A ridge on the models' predictions, fitted on earlier folds' out-of-fold rows; the first fold has none."""
    wide = predictions.groupBy("series", "fold", "t", "close", "actual").pivot("model", list(models)).agg(F.first("pred"))
    table = _expanding(linear.gram(wide.na.drop(), list(models), "actual", ["series", "fold"]), models, alpha, ("series",), least)
    return _score(wide, table, models, ["series", "fold"]).where("pred IS NOT NULL").select("series", F.lit("stack").alias("model"), "fold", "t", "close", "actual", "pred")


def selective(predictions: DataFrame, coverages: Sequence[float] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Each fold's predictions with ``kept``: beyond the threshold whose Wilson bound was best on earlier folds.

    Candidate thresholds are quantiles of abs(pred) over the earlier folds; ties go to the larger coverage.
    """
    size = F.abs("pred")
    folds = predictions.select("series", "model", "fold").distinct().withColumnRenamed("fold", "for_fold")
    earlier = predictions.join(folds, ["series", "model"]).where("fold < for_fold")  # a row a later fold, few folds
    keys = ["series", "model", "for_fold"]
    cuts = quantiles.quantiles(earlier.withColumn("_size", size), keys, "_size", [1 - c for c in coverages])
    coverage = F.create_map(*[F.lit(v) for c in coverages for v in (float(1 - c), float(c))])
    cuts = cuts.select(*keys, coverage[F.col("probability")].alias("coverage"), F.col("quantile").alias("threshold"))
    kept = (size >= F.col("threshold")) & (F.col("actual") != 0)
    hit = kept & (F.signum("pred") == F.signum("actual"))
    scored = earlier.join(cuts, keys).groupBy(*keys, "coverage", "threshold").agg(F.sum(kept.cast("int")).alias("n"), F.sum(hit.cast("int")).alias("hits"))
    scored = scored.withColumn("wilson", F.coalesce(wilson_lower(F.col("hits"), F.col("n")), F.lit(-1.0)))
    best = scored.groupBy(*keys).agg(F.max_by("threshold", F.struct("wilson", "coverage")).alias("threshold")).withColumnRenamed("for_fold", "fold")
    return predictions.join(best, ["series", "model", "fold"]).withColumn("kept", size >= F.col("threshold"))


def regime_specialists(rows: DataFrame, features: Sequence[str], regime: str = "regime", alpha: float = 10.0, least: int = 150) -> DataFrame:
    """Ridges for each regime, fitted on earlier folds of (series, regime, fold, features, actual); regimes with
    fewer than ``least`` rows fall back to the series' own ridge, then to zero."""
    filled = rows.na.fill(0.0, list(features)).where(F.col(regime).isNotNull())
    own = _expanding(linear.gram(filled, features, "actual", ["series", regime, "fold"]), features, alpha, ("series", regime), least)
    whole = _expanding(linear.gram(filled, features, "actual", ["series", "fold"]), features, alpha, ("series",), least)
    special = _score(filled, own, features, ["series", regime, "fold"]).withColumnRenamed("pred", "_special")
    both = _score(special, whole, features, ["series", "fold"])
    source = F.when(F.col("_special").isNotNull(), "SPECIALIST").when(F.col("pred").isNotNull(), "SERIES").otherwise("BASELINE")
    return both.withColumns({"source": source, "pred": F.coalesce("_special", "pred", F.lit(0.0))}).drop("_special")


def evidence(improvement: Column, low: Column, p_better: Column) -> Column:
    """STRONG, PROMISING or NO_STABLE by the bootstrap of an improvement."""
    return F.when((low > 0) & (p_better >= 0.99), "STRONG").when((improvement > 0) & (p_better >= 0.9), "PROMISING").otherwise("NO_STABLE")


def newest_fold(predictions: DataFrame) -> DataFrame:
    """The last fold of each series."""
    last = F.max("fold").over(Window.partitionBy("series"))
    return predictions.withColumn("_l", last).where("fold = _l").drop("_l")
