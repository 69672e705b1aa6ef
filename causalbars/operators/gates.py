"""Gates: named rules over rows, the codes of those that fail, and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(rows: DataFrame, faults: dict[str, Column]) -> DataFrame:
    """Adds failures (codes in order, comma-joined) and verdict: PASS without any, else REJECT.

    A rule that cannot be judged (NULL) fails: gates are closed when in doubt.
    """
    codes = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in faults.items()]))
    joined = F.array_join(codes, ",")
    return rows.withColumns({"failures": joined, "verdict": F.when(joined == "", "PASS").otherwise("REJECT")})


def period_wins(folds: DataFrame, baseline: str) -> DataFrame:
    """Folds in which each model (series, model, fold, mae) beats a baseline, by series, with the mean margin."""
    base = folds.where(F.col("model") == baseline).select("series", "fold", F.col("mae").alias("_base"))
    joined = folds.where(F.col("model") != baseline).join(base, ["series", "fold"])
    return joined.groupBy("series", "model").agg(F.count("*").alias("folds"), F.sum((F.col("mae") < F.col("_base")).cast("int")).alias("wins"), F.avg(F.col("_base") - F.col("mae")).alias("mean_margin"))
