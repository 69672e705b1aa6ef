"""Frozen linear scoring and ridge regression from sums of products."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles


@dataclass(frozen=True)
class LinearModel:
    """Medians for missing values, indicators of some features, standardisation, coefficients, intercept."""

    features: tuple[str, ...]
    medians: tuple[float, ...]
    indicators: tuple[int, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def __post_init__(self):
        width = len(self.features) + len(self.indicators)
        if len(self.medians) != len(self.features) or {len(self.means), len(self.scales), len(self.coefficients)} != {width}:
            raise ValueError("a linear model's parts must have one entry a feature and indicator")

    def score(self) -> Column:
        """The prediction as one column expression: no Python on the executors."""
        values = [F.coalesce(F.col(f), F.lit(m)) for f, m in zip(self.features, self.medians)]
        values += [F.col(self.features[i]).isNull().cast("double") for i in self.indicators]
        total = F.lit(self.intercept)
        for x, mean, scale, weight in zip(values, self.means, self.scales, self.coefficients):
            total = total + (x - mean) / scale * weight
        return total


def impute_stats(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: the exact median (0 if all are missing) and the missing count of each feature. Medians are selected by
    :func:`quantiles.column_quantiles`, so no task holds a column."""
    listed = F.array(*[F.struct(F.lit(f).alias("column"), F.sum(F.col(f).isNull().cast("int")).alias("missing")) for f in features])
    missing = rows.agg(listed.alias("x")).select(F.explode("x").alias("x")).select("x.*", F.lit(None).cast("double").alias("quantile"))
    both = missing.unionByName(quantiles.column_quantiles(rows, features, 0.5), allowMissingColumns=True)
    pick = lambda f, c: F.max(F.when(F.col("column") == f, F.col(c)))
    return both.agg(*[F.coalesce(pick(f, "quantile"), F.lit(0.0)).alias(f"median_{f}") for f in features], *[pick(f, "missing").alias(f"missing_{f}") for f in features])


def gram(rows: DataFrame, features: Sequence[str], label: str, by: Sequence[str]) -> DataFrame:
    """Sums of products of features and label in long form (i, j, sum_xy, n) of each group: mergeable by addition,
    so expanding folds and feature subsets need no further pass over the rows."""
    names = [*features, label]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    wide = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.col(a)).alias(f"s|{a}") for a in names], *[F.sum(F.col(a) * F.col(b)).alias(f"p|{a}|{b}") for a, b in pairs])
    entries = F.array(*[F.struct(F.lit(a).alias("i"), F.lit("1").alias("j"), F.col(f"`s|{a}`").alias("sum_xy")) for a in names], *[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"`p|{a}|{b}`").alias("sum_xy")) for a, b in pairs])
    return wide.select(*by, "n", F.explode(entries).alias("e")).select(*by, "n", "e.*")


def ridge_of(moment: np.ndarray, at: Sequence[int], label: int, alpha: float) -> tuple[float, np.ndarray]:
    """Offset and weights of a ridge on standardised features (population deviation, unpenalised intercept) from the
    sums of products of ("1", columns): ``at`` and ``label`` are places of the features and the label.

    The system has one row a feature, whatever the number of rows summed. Without features: the label's mean.
    """
    n, target = moment[0, 0], moment[0, label] / moment[0, 0]
    if not len(at):
        return float(target), np.zeros(0)
    at = np.asarray(at)
    mean = moment[0, at] / n
    spread = moment[np.ix_(at, at)] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread), 0))
    scale[scale < 1e-12] = 1.0
    product = (moment[at, label] / n - mean * target) / scale * n
    weights = np.linalg.solve(spread / np.outer(scale, scale) * n + alpha * np.eye(len(at)), product) / scale
    return float(target - weights @ mean), weights


def solve_groups(cells: DataFrame, keys: Sequence[str], subsets: dict[str, Sequence[str]], label: str, alpha: float, expanding: str | None = None, least: int = 1) -> DataFrame:
    """Ridges of each group of :func:`gram` cells and feature subset, solved on the executors: keys, model, n, offset and
    weights over the sorted features of all subsets.

    With ``expanding`` (a key), a group's fit takes the sums of the groups before it by that key, and the first has
    none. Groups with fewer than ``least`` rows have none.
    """
    import pandas as pd

    names = ["1", *sorted({f for s in subsets.values() for f in s}), label]
    place = {x: i for i, x in enumerate(names)}
    outer = [k for k in keys if k != expanding]
    kinds = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        rows, total = [], np.zeros((len(names), len(names)))
        for _, own in frame.groupby(expanding, sort=True) if expanding else [(None, frame)]:
            moment = np.zeros_like(total)
            moment[0, 0] = own["n"].iloc[0]
            for i, j, v in zip(own["i"], own["j"], own["sum_xy"]):
                if i in place and j in place:
                    moment[place[i], place[j]] = moment[place[j], place[i]] = v
            used = total.copy() if expanding else moment
            total += moment
            if used[0, 0] >= max(least, 1):
                for model, features in subsets.items():
                    offset, weights = ridge_of(used, [place[f] for f in features], place[label], alpha)
                    line = np.zeros(len(names))
                    line[[place[f] for f in features]] = weights
                    rows.append((*(own[k].iloc[0] for k in keys), model, int(used[0, 0]), offset, line[1:-1].tolist()))
        return pd.DataFrame(rows, columns=[*keys, "model", "n", "offset", "weights"])

    return cells.groupBy(*outer).applyInPandas(solve, f"{kinds}, model string, n long, offset double, weights array<double>")


def dot(features: Sequence[str], weights: str) -> Column:
    """The sum of features times the entries of an array column; a feature without a weight adds nothing, whatever its value."""
    products = F.zip_with(F.array(*[F.col(f).cast("double") for f in features]), weights, lambda x, w: F.when(w.isNull(), 0.0).otherwise(x * w))
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def solve_ridge(cells: Sequence[tuple[str, str, float]], n: int, features: Sequence[str], label: str, alpha: float) -> dict:
    """Ridge on standardised features (population deviation, unpenalised intercept) from one group's sums.

    The system has one row a feature, whatever the number of rows summed.
    """
    at = {(i, j): v for i, j, v in cells}
    k = len(features)
    mean = np.array([at[f, "1"] for f in features]) / n
    moment = np.array([[at.get((a, b), at.get((b, a))) for b in features] for a in features]) / n
    scale = np.sqrt(np.maximum(np.diag(moment) - mean**2, 0))
    scale[scale < 1e-12] = 1.0
    centred = (moment - np.outer(mean, mean)) / np.outer(scale, scale) * n
    target = at[label, "1"] / n
    product = (np.array([at.get((f, label), at.get((label, f))) for f in features]) / n - mean * target) / scale * n
    weights = np.linalg.solve(centred + alpha * np.eye(k), product)
    return {"coefficients": weights, "means": mean, "scales": scale, "intercept": target}


def fit_ridge(rows: DataFrame, features: Sequence[str], label: str, alpha: float) -> LinearModel:
    """Median imputation, indicators of features missing in training, standardisation, ridge: three aggregates."""
    stats = impute_stats(rows, features).first()
    medians = [float(stats[f"median_{f}"]) for f in features]
    indicators = tuple(i for i, f in enumerate(features) if stats[f"missing_{f}"])
    named = {f: F.coalesce(F.col(f), F.lit(m)) for f, m in zip(features, medians)} | {f"missing_{features[i]}": F.col(features[i]).isNull().cast("double") for i in indicators}
    names = list(named)
    filled = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("_label"), *[x.alias(n) for n, x in named.items()])
    cells = gram(filled.withColumn("_all", F.lit(1)), names, "_label", ["_all"]).collect()  # (features + 1)² / 2 rows
    solved = solve_ridge([(r["i"], r["j"], r["sum_xy"]) for r in cells], cells[0]["n"], names, "_label", alpha)
    return LinearModel(tuple(features), tuple(medians), indicators, tuple(map(float, solved["means"])), tuple(map(float, solved["scales"])), tuple(map(float, solved["coefficients"])), float(solved["intercept"]))
