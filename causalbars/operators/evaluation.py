"""Forecast metrics, strategies, regimes, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import wilson_lower
from ..functions.tables import written
from . import quantiles


def correlation(a: str, b: str) -> Column:
    """Pearson; NULL (no error) if either side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def with_ranks(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds rank_<column>: ranks within ``by`` with ties at their average."""
    for c in columns:
        rows = quantiles.ranks(rows, by, c, f"rank_{c}")
    return rows


def forecast_metrics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics of (actual, pred, close) by group. Sums are one aggregate; ranks and the median are taken without a
    group's rows ever meeting in one task. Keys must not be null. The predictions are written once, as each of these
    reads them."""
    rows = written(rows.select(*by, "actual", "pred", "close"), "predictions")
    error = F.col("pred") - F.col("actual")
    price, truth = F.col("close") * F.exp("pred"), F.col("close") * F.exp("actual")
    moved = F.when(F.col("actual") != 0, (F.signum("pred") == F.signum("actual")).cast("double"))
    ranked = with_ranks(rows, by, ("actual", "pred"))
    sums = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop("actual") * F.count("*"))).alias("r2"), F.avg(moved).alias("direction_accuracy"), correlation("actual", "pred").alias("pearson_ic"),
        correlation("rank_actual", "rank_pred").alias("spearman_ic"), F.avg(error).alias("bias"), F.stddev_pop("pred").alias("pred_std"),
        F.avg(F.abs(price - truth)).alias("price_mae"), F.sqrt(F.avg((price - truth) * (price - truth))).alias("price_rmse"), F.avg(F.abs(F.try_divide(price - truth, truth))).alias("price_mape"),
    )
    median = quantiles.quantile_columns(rows.withColumn("_e", F.abs(error)), by, "_e", {"median_ae": 0.5})
    return sums.join(median, list(by), "left")


def direction_metrics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Compact metrics: MAE, sign accuracy with zeros, balanced accuracy over moves, majority sign (ties: +1)."""
    up, down = F.avg(F.when(F.col("actual") > 0, (F.col("pred") > 0).cast("double"))), F.avg(F.when(F.col("actual") < 0, (F.col("pred") < 0).cast("double")))
    share_up = F.avg(F.when(F.col("actual") != 0, (F.col("actual") > 0).cast("double")))
    return rows.groupBy(*by).agg(F.avg(F.abs(F.col("pred") - F.col("actual"))).alias("mae"), F.avg((F.signum("pred") == F.signum("actual")).cast("double")).alias("sign_accuracy"), ((up + down) / 2).alias("balanced_accuracy"), F.when(F.coalesce(share_up, F.lit(1.0)) >= 0.5, 1).otherwise(-1).alias("majority_sign"))


def turnover(rows: DataFrame, by: Sequence[str], period: Column) -> DataFrame:
    """Position changes of sign(pred) with a reset each period, flips, and the cost (bps) at which gains vanish."""
    w = Window.partitionBy(*by, "_period").orderBy("t")
    marked = rows.withColumn("_period", period).withColumn("_position", F.signum("pred"))
    before = F.coalesce(F.lag("_position").over(w), F.lit(0.0))
    moved = marked.withColumns({"_moved": F.abs(F.col("_position") - before), "_flip": (F.col("_position") * before < 0).cast("int"), "_gain": F.col("_position") * F.col("actual")})
    total = F.sum("_moved")
    return moved.groupBy(*by).agg(total.alias("turnover_units"), F.avg("_flip").alias("flip_rate"), F.sum("_gain").alias("gross_return"), (F.try_divide(F.sum("_gain"), total) * 10_000).alias("break_even_bps"))


def candidate_summary(folds: DataFrame) -> DataFrame:
    """Mean and spread over folds of each model, folds won against the rest, and rank by (mean, spread, name)."""
    best = F.min_by("model", F.struct("mae", "model")).over(Window.partitionBy("series", "fold"))
    per = folds.withColumn("_won", (best == F.col("model")).cast("int"))
    done = per.groupBy("series", "model").agg(F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("std_mae"), F.max("mae").alias("worst_mae"), F.sum("_won").alias("folds_won"), F.count("*").alias("folds"))
    return done.withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy("mean_mae", "std_mae", "model")))


def selective(rows: DataFrame, by: Sequence[str], coverages: Sequence[float]) -> DataFrame:
    """For each coverage: the threshold on abs(pred) that keeps that share, rows kept, hits, Wilson lower bound."""
    size = F.abs("pred")
    cuts = quantiles.quantiles(rows.withColumn("_size", size), by, "_size", [1 - x for x in coverages])
    coverage = F.create_map(*[F.lit(v) for x in coverages for v in (float(1 - x), float(x))])
    cuts = cuts.select(*by, coverage[F.col("probability")].alias("coverage"), F.col("quantile").alias("threshold"))
    joined = rows.join(cuts, list(by))  # one row for each wanted coverage
    kept = (size >= F.col("threshold")) & (F.col("actual") != 0)
    hit = kept & (F.signum("pred") == F.signum("actual"))
    done = joined.groupBy(*by, "coverage", "threshold").agg(F.sum(kept.cast("int")).alias("kept"), F.sum(hit.cast("int")).alias("hits"))
    return done.withColumn("wilson", wilson_lower(F.col("hits"), F.col("kept")))


def regimes(frame: DataFrame, train: Column, volatility: str, trend: str, share: float = 0.67) -> DataFrame:
    """HIGH_VOL, TREND_UP, TREND_DOWN or RANGE by quantiles of the train rows of each series only."""
    own = frame.where(train).withColumn("_size", F.abs(trend))
    cuts = own.select("series").distinct()
    for value, name in ((volatility, "_vol"), ("_size", "_trend")):
        cuts = cuts.join(quantiles.quantile_columns(own, ["series"], value, {name: share}), "series", "left")
    joined = frame.join(cuts, "series")
    label = F.when(F.col(volatility) >= F.col("_vol"), "HIGH_VOL").when((F.abs(trend) >= F.col("_trend")) & (F.col(trend) > 0), "TREND_UP").when((F.abs(trend) >= F.col("_trend")) & (F.col(trend) < 0), "TREND_DOWN").otherwise("RANGE")
    return joined.withColumn("regime", F.when(F.col(volatility).isNotNull() & F.col(trend).isNotNull(), label)).drop("_vol", "_trend")


def strategy_returns(rows: DataFrame, least_std: float = 1e-15) -> DataFrame:
    """sign(pred) * actual of each (series, model, t); constant strategies are dropped."""
    made = rows.select("series", "model", "t", (F.signum("pred") * F.col("actual")).alias("ret"))
    alive = made.groupBy("series", "model").agg(F.stddev_samp("ret").alias("_s")).where(F.col("_s") > least_std)
    return made.join(alive.select("series", "model"), ["series", "model"], "left_semi")


def selection_gate(summary: DataFrame, baseline: str, least_wins: int) -> DataFrame:
    """Checks of each candidate against a baseline and the chosen one of each series (best, ties by name)."""
    base = summary.where(F.col("model") == baseline).select("series", F.col("mean_mae").alias("_base"))
    joined = summary.join(base, "series")
    better, steady = F.col("mean_mae") < F.col("_base"), F.col("folds_won") >= least_wins
    checked = joined.withColumns({"improvement": 1 - F.try_divide("mean_mae", "_base"), "passes": better & steady & (F.col("model") != baseline)})
    pick = F.min_by(F.when(F.col("passes"), F.col("model")), F.struct(~F.col("passes"), "mean_mae", "model")).over(Window.partitionBy("series"))
    return checked.withColumn("chosen", F.coalesce(pick, F.lit(baseline))).drop("_base")
