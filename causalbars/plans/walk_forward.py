"""Walk-forward evaluation of linear models: one pass of sums serves all folds and feature subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, linear, splits


def ridge_walk_forward(rows: DataFrame, subsets: dict[str, Sequence[str]], alpha: float = 10.0, folds: int = 4) -> DataFrame:
    """Predictions (series, model, fold, t, actual, pred) of a ridge for each feature subset and fold.

    Rows need (series, t, target_t, close, actual) and all features; missing features count as zero. Sums of
    products are taken once a fold's train rows; each subset solves its own small system from them, on the executor
    that has the series and fold.
    """
    names = sorted({f for s in subsets.values() for f in s})
    marked = splits.walk_forward(rows.na.fill(0.0, names), folds)
    cells = linear.gram(marked.where("role = 'train'"), names, "actual", ["series", "fold"])
    table = linear.solve_groups(cells, ["series", "fold"], subsets, "actual", alpha).drop("n")
    scored = marked.where("role = 'validation'").join(table, ["series", "fold"])
    pred = F.col("offset") + linear.dot(names, "weights")
    return scored.select("series", "model", "fold", "t", "close", "actual", pred.alias("pred"))


def compare(predictions: DataFrame) -> DataFrame:
    """Metrics by series, model and fold."""
    return evaluation.forecast_metrics(predictions, ["series", "model", "fold"])
