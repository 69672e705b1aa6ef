"""Models over features: no SQL equals them, so these are checked by rows, metrics and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, features, targets
from ..operators.features import trend, volatility
from ..plans import estimators, meta, walk_forward
from ._sql import line, r, ridge, rounded, rs
from .evaluation import _METRICS
from .features import _HOURLY, _PRICE, _RSI, bars_of
from .stacking import _WALK

NAMES = ("log_return_1h", "log_return_6h", "candle_range_pct", "rsi_14h")


def frame(spark, d):
    bars = bars_of(spark, d)
    labels = targets.next_bar(bars).where("target_t IS NOT NULL").select("series", "t", "close", "target_t", F.col("target_log_return").alias("actual"))
    return features.base_features(bars).select("series", "t", *NAMES).join(labels, ["series", "t"])


def oof(spark, d):
    return walk_forward.ridge_walk_forward(frame(spark, d), {"returns": NAMES[:2], "all": NAMES})


def ridge_walk_forward(spark, d):
    return rounded(walk_forward.compare(oof(spark, d)))


def oof_stacking(spark, d):
    return rounded(evaluation.direction_metrics(meta.stack(oof(spark, d), ["returns", "all"]), ["series", "fold"]))


def selective_prediction(spark, d):
    kept = meta.selective(oof(spark, d)).where("kept")
    return rounded(evaluation.direction_metrics(kept, ["series", "model", "fold"]))


def regime_adaptive(spark, d):
    bars = bars_of(spark, d)
    moves = volatility(bars).select("series", "t", "realized_vol_24h").join(trend(bars).select("series", "t", "close_vs_sma_24h"), ["series", "t"])
    labelled = evaluation.regimes(moves, F.col("t") < 1705000000, "realized_vol_24h", "close_vs_sma_24h")
    rows = frame(spark, d).join(labelled.select("series", "t", "regime"), ["series", "t"]).withColumn("fold", F.floor((F.col("t") - 1704067200) / 518_400).cast("int"))
    done = meta.regime_specialists(rows, NAMES, least=40)
    return done.groupBy("series", "fold", "source").agg(F.count("*").alias("n"))


def estimator_walk_forward(spark, d):
    done = estimators.walk_forward(frame(spark, d), NAMES, ("elastic_net", "huber", "forest"))
    return rounded(evaluation.direction_metrics(done, ["series", "model", "fold"]))


QUERIES = {f.__name__: f for f in (ridge_walk_forward, oof_stacking, selective_prediction, regime_adaptive, estimator_walk_forward)}
_SETS = {"returns": list(NAMES[:2]), "all": list(NAMES)}
_FEATS = _HOURLY + f""", named AS (SELECT series, t, close, lead(t) OVER w AS due, lead(close) OVER w AS nc, ln(close) - ln(p1) AS log_return_1h,
  ln(close) - ln(max(close) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN 21600 PRECEDING AND 21600 PRECEDING)) AS log_return_6h, {_PRICE["candle_range_pct"]} AS candle_range_pct, {_RSI} AS rsi_14h
  FROM hourly JOIN rsi0 USING (series, t) WINDOW w AS (PARTITION BY series ORDER BY t)),
feats AS (SELECT series, t, t + 3600 AS end_t, close, ln(nc) - ln(close) AS actual, {", ".join(f"coalesce({x}, 0) AS {x}" for x in NAMES)} FROM named WHERE due = t + 3600),
numbered AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) AS n, count(*) OVER (PARTITION BY series) AS rows FROM feats)"""
#: Out-of-fold predictions: wide with p_returns and p_all, long with model and pred.
_OOF = f"""{_FEATS}, {_WALK}, tr AS (SELECT * FROM roles WHERE role = 'train'), {", ".join(ridge(f"m_{k}", "tr", "series, fold", own, "actual", 10.0) for k, own in _SETS.items())},
wide AS (SELECT series, fold, t, close, actual, {", ".join(f"{line(f'm_{k}', own, 'roles')} AS p_{k}" for k, own in _SETS.items())} FROM roles JOIN m_returns USING (series, fold) JOIN m_all USING (series, fold) WHERE role = 'test'),
preds AS ({" UNION ALL ".join(f"SELECT series, '{k}' AS model, fold, t, close, actual, p_{k} AS pred FROM wide" for k in _SETS)})"""
_DIRECTION = rs({"mae": "avg(abs(pred - actual))", "sign_accuracy": "avg((sign(pred) = sign(actual))::INT)", "balanced_accuracy": "(avg(CASE WHEN actual > 0 THEN (pred > 0)::INT END) + avg(CASE WHEN actual < 0 THEN (pred < 0)::INT END)) / 2"})
_DIRECTION += ", CASE WHEN coalesce(avg(CASE WHEN actual <> 0 THEN (actual > 0)::INT END), 1) >= 0.5 THEN 1 ELSE -1 END AS majority_sign"
_Z = "1.959963984540054"
ORACLES: dict[str, str] = {
    "ridge_walk_forward": f"""WITH {_OOF}, k AS (SELECT *, rank() OVER (PARTITION BY series, model, fold ORDER BY actual) + (count(*) OVER (PARTITION BY series, model, fold, actual) - 1) / 2.0 AS ra,
      rank() OVER (PARTITION BY series, model, fold ORDER BY pred) + (count(*) OVER (PARTITION BY series, model, fold, pred) - 1) / 2.0 AS rp FROM preds) SELECT series, model, fold, count(*) AS n, {rs(_METRICS)} FROM k GROUP BY series, model, fold""",
    "oof_stacking": f"""WITH {_OOF}, earlier AS (SELECT a.series, b.fold, a.actual, a.p_returns, a.p_all FROM wide a JOIN (SELECT DISTINCT series, fold FROM wide) b ON a.series = b.series AND a.fold < b.fold QUALIFY count(*) OVER (PARTITION BY a.series, b.fold) >= 50),
      {ridge("meta", "earlier", "series, fold", ["p_returns", "p_all"], "actual", 1.0)}, stacked AS (SELECT series, fold, actual, {line("meta", ["p_returns", "p_all"], "wide")} AS pred FROM wide JOIN meta USING (series, fold)) SELECT series, fold, {_DIRECTION} FROM stacked GROUP BY series, fold""",
    "selective_prediction": f"""WITH {_OOF}, earlier AS (SELECT p.series, p.model, f.fold, p.actual, p.pred FROM preds p JOIN (SELECT DISTINCT series, model, fold FROM preds) f ON p.series = f.series AND p.model = f.model AND p.fold < f.fold),
      cuts AS (SELECT series, model, fold, unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS coverage, unnest(quantile_cont(abs(pred), [0.75, 0.5, 0.25, 0.0])) AS threshold FROM earlier GROUP BY series, model, fold),
      hit AS (SELECT series, model, fold, coverage, threshold, count(*) FILTER (abs(pred) >= threshold AND actual <> 0) AS n, count(*) FILTER (abs(pred) >= threshold AND actual <> 0 AND sign(pred) = sign(actual)) AS h FROM earlier JOIN cuts USING (series, model, fold) GROUP BY ALL),
      scored AS (SELECT *, coalesce((h / n + {_Z} ** 2 / (2 * n) - {_Z} * sqrt((h / n) * (1 - h / n) / n + {_Z} ** 2 / (4 * n * n))) / (1 + {_Z} ** 2 / n), -1) AS wilson FROM hit),
      best AS (SELECT series, model, fold, arg_max(threshold, (wilson, coverage)) AS threshold FROM scored GROUP BY ALL),
      kept AS (SELECT p.* FROM preds p JOIN best USING (series, model, fold) WHERE abs(pred) >= threshold) SELECT series, model, fold, {_DIRECTION} FROM kept GROUP BY series, model, fold""",
}
