"""Splits, metrics, strategies, resampling and selection over baseline forecasts of each event type's bars."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions.timeops import exact_lag
from ..operators import evaluation as op
from ..operators import resampling, splits, targets
from ..sources import tables as src
from ._sql import BARS, base_least, lag, r, roll, rounded, rs
from .features import bars_of

FOLD = 240 * 3600


def labelled(spark, d):
    return targets.next_bar(bars_of(spark, d)).where("target_t IS NOT NULL").select("series", "t", "close", "target_t", F.col("target_log_return").alias("actual"))


def forecasts(spark, d):
    """Long table of baseline forecasts: zero, previous return, mean return of six hours."""
    c = F.col("close")
    own = targets.next_bar(bars_of(spark, d)).select("series", "t", "close", F.col("target_log_return").alias("actual"), F.coalesce(F.ln(c) - F.ln(exact_lag(c, 1)), F.lit(0.0)).alias("previous"), F.coalesce((F.ln(c) - F.ln(exact_lag(c, 6))) / 6, F.lit(0.0)).alias("drift"))
    models = F.array(F.struct(F.lit("zero").alias("model"), F.lit(0.0).alias("pred")), F.struct(F.lit("previous").alias("model"), F.col("previous").alias("pred")), F.struct(F.lit("drift").alias("model"), F.col("drift").alias("pred")))
    return own.where("actual IS NOT NULL").select("series", "t", "close", "actual", F.explode(models).alias("m")).select("series", "m.model", "t", "close", "actual", "m.pred").withColumn("fold", F.floor(F.col("t") / FOLD).cast("long"))


def strategies(spark, d):
    return op.strategy_returns(forecasts(spark, d))


def chronological_split(spark, d):
    return splits.chronological(labelled(spark, d)).select("series", "t", "split")


def walk_forward_roles(spark, d):
    return splits.walk_forward(labelled(spark, d), history_hours=360).select("series", "t", "fold", "role")


def calendar_folds(spark, d):
    return splits.calendar_folds(labelled(spark, d), FOLD, least_train=50).select("series", "t", "fold", "role")


def locked_tail_folds(spark, d):
    return splits.locked_tail(labelled(spark, d)).select("series", "t", "fold", "role")


def combinatorial_roles(spark, d):
    return splits.combinatorial(labelled(spark, d)).groupBy("series", "split_id", "role").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def leakage_report(spark, d):
    rows = labelled(spark, d)
    loose = F.when(F.col("t") % 7 == 0, "train").when(F.col("t") < 1705800000, "train").when(F.col("t") < 1706200000, "validation").otherwise("test")
    return splits.leakage_report(rows.withColumn("split", loose))


def coverage_gate(spark, d):
    rows = splits.calendar_folds(labelled(spark, d), FOLD)
    return rounded(splits.coverage(rows, F.col("actual") > 0, 0.5, 60))


def forecast_metrics(spark, d):
    return rounded(op.forecast_metrics(forecasts(spark, d), ["series", "model", "fold"]))


def direction_metrics(spark, d):
    return rounded(op.direction_metrics(forecasts(spark, d), ["series", "model"]))


def turnover(spark, d):
    return rounded(op.turnover(forecasts(spark, d), ["series", "model"], F.col("fold")))


def fold_mae(spark, d):
    return forecasts(spark, d).groupBy("series", "model", "fold").agg(F.round(F.avg(F.abs(F.col("pred") - F.col("actual"))), 9).alias("mae"))


def candidate_summary(spark, d):
    return rounded(op.candidate_summary(fold_mae(spark, d)))


def selection_gate(spark, d):
    done = op.selection_gate(op.candidate_summary(fold_mae(spark, d)), "previous", 2)
    return rounded(done.select("series", "model", "improvement", "passes", "chosen"))


def threshold_coverage_wilson(spark, d):
    return rounded(op.selective(forecasts(spark, d).where("model = 'previous'"), ["series"], (0.25, 0.5, 0.75)))


def regime_labels(spark, d):
    from ..operators.features import trend, volatility

    frame = volatility(bars_of(spark, d)).select("series", "t", "realized_vol_24h").join(trend(bars_of(spark, d)).select("series", "t", F.col("close_vs_sma_24h")), ["series", "t"])
    done = op.regimes(frame, F.col("t") < 1705000000, "realized_vol_24h", "close_vs_sma_24h")
    return done.groupBy("series", "regime").agg(F.count("*").alias("n"))


def strategy_returns(spark, d):
    return rounded(strategies(spark, d))


def sharpe_moments(spark, d):
    return rounded(resampling.sharpe_moments(strategies(spark, d)))


def pbo_cscv(spark, d):
    return rounded(resampling.overfitting(strategies(spark, d)))


def block_bootstrap(spark, d):
    wide = forecasts(spark, d).groupBy("series", "t").agg(F.max(F.when(F.col("model") == "previous", F.abs(F.col("pred") - F.col("actual")))).alias("a"), F.max(F.when(F.col("model") == "zero", F.abs(F.col("actual")))).alias("b"))
    return rounded(resampling.mean_interval(wide.select("series", "t", (F.col("a") - F.col("b")).alias("gain")), "series", "gain", 200, 24))


def circular_bootstrap(spark, d):
    rows = strategies(spark, d).where("model = 'drift'").select(F.concat_ws("|", "series", F.floor(F.col("t") / FOLD).cast("string")).alias("stratum"), "t", "ret")
    return rounded(resampling.mean_interval(rows, "stratum", "ret", 100, 24, circular=True))


def conditional_bootstrap(spark, d):
    rows = forecasts(spark, d).where("model = 'previous'").select("series", "t", (F.abs("pred") > 0.5).cast("double").alias("chosen"), ((F.abs("pred") > 0.5) & (F.signum("pred") == F.signum("actual"))).cast("double").alias("hit"))
    return rounded(resampling.conditional_interval(rows, "series", "hit", "chosen", 200, 24))


def holm_adjusted(spark, d):
    return rounded(resampling.zero_mean_tests(strategies(spark, d), 200, 24))


STAGES = {"initial": 10, "feature_sets": 5, "coverages": 5, "regimes": 12, "stack": 1}


def _trials(spark, rows):
    stages = F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), F.lit(v).cast("long").alias("counted_trials")) for k, v in STAGES.items()]))
    return rows.select("series").distinct().select("series", stages.alias("x")).select("series", "x.*")


def stratified_bootstrap(spark, d):
    """Gains over the zero forecast of two models and a conditional hit rate, folds as strata, one set of draws."""
    error = lambda m: F.max(F.when(F.col("model") == m, F.abs(F.col("pred") - F.col("actual"))))
    pred = F.max(F.when(F.col("model") == "previous", F.col("pred")))
    wide = forecasts(spark, d).groupBy("series", "fold", "t", "actual").agg(error("zero").alias("z"), error("previous").alias("p"), error("drift").alias("q"), pred.alias("pred"))
    chosen = F.abs("pred") > 0.5
    rows = wide.select("series", "fold", "t", (F.col("z") - F.col("p")).alias("gain_previous"), (F.col("z") - F.col("q")).alias("gain_drift"), chosen.cast("double").alias("chosen"), (chosen & (F.signum("pred") == F.signum("actual"))).cast("double").alias("hit"))
    mean = {c: F.col(c) / F.col("rows") for c in ("gain_previous", "gain_drift")}
    return rounded(resampling.stratified_intervals(rows, ["series"], "fold", ["gain_previous", "gain_drift", "chosen", "hit"], mean | {"hit_rate": F.when(F.col("chosen") > 0, F.col("hit") / F.col("chosen"))}, 2000, 24))


def deflated_sharpe(spark, d):
    rows = strategies(spark, d)
    done = resampling.deflated_sharpes(rows, _trials(spark, rows))
    return rounded(done.select("series", "model", "n", "strategies", "counted_trials", "sharpe", "trial_mean", "trial_std", "benchmark", "z", "probability"))


def robustness_gates(spark, d):
    rows = strategies(spark, d)
    mae = fold_mae(spark, d)
    zero = mae.where("model = 'zero'").select("series", "fold", F.col("mae").alias("zero_mae"))
    wins = mae.join(zero, ["series", "fold"]).groupBy("series", "model").agg(F.avg((F.col("mae") < F.col("zero_mae")).cast("double")).alias("better_fraction"))
    done = resampling.robustness_gates(resampling.deflated_sharpes(rows, _trials(spark, rows)), resampling.overfitting(rows), resampling.zero_mean_tests(rows, 200, 24), wins)
    return rounded(done)


PRED = BARS + f""", p0 AS (SELECT series, t, close, CASE WHEN lead(t) OVER w = t + 3600 THEN t + 3600 END AS target_t, CASE WHEN lead(t) OVER w = t + 3600 THEN ln(lead(close) OVER w) - ln(close) END AS actual,
  coalesce(ln(close) - ln({lag("close", 1)}), 0) AS m1, coalesce((ln(close) - ln({lag("close", 6)})) / 6, 0) AS m6 FROM bars WINDOW w AS (PARTITION BY series ORDER BY t)),
lab AS (SELECT series, t, close, target_t, actual FROM p0 WHERE actual IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) AS n, count(*) OVER (PARTITION BY series) AS rows FROM lab),
preds AS (SELECT series, m.model, t, close, actual, m.pred, t // {FOLD} AS fold FROM (SELECT *, unnest([{{'model': 'zero', 'pred': 0.0::DOUBLE}}, {{'model': 'previous', 'pred': m1}}, {{'model': 'drift', 'pred': m6}}]) AS m FROM p0 WHERE actual IS NOT NULL)),
made AS (SELECT series, model, t, sign(pred) * actual AS ret FROM preds),
strategies AS (SELECT * FROM made SEMI JOIN (SELECT series, model FROM made GROUP BY ALL HAVING stddev_samp(ret) > 1e-15) USING (series, model))"""

_CAL = PRED + f""", periods AS (SELECT DISTINCT series, t // {FOLD} AS fold FROM lab), marked AS (SELECT lab.*, fold, CASE WHEN t // {FOLD} = fold THEN 'validation' WHEN target_t < fold * {FOLD} THEN 'train' END AS role FROM lab JOIN periods USING (series)),
kept AS (SELECT * FROM marked WHERE role IS NOT NULL)"""
_METRICS = {
    "mae": "avg(abs(pred - actual))", "rmse": "sqrt(avg((pred - actual) ** 2))", "median_ae": "median(abs(pred - actual))", "r2": "1 - sum((pred - actual) ** 2) / nullif(var_pop(actual) * count(*), 0)",
    "direction_accuracy": "avg(CASE WHEN actual <> 0 THEN (sign(pred) = sign(actual))::INT END)", "pearson_ic": "covar_pop(actual, pred) / nullif(stddev_pop(actual) * stddev_pop(pred), 0)",
    "spearman_ic": "covar_pop(ra, rp) / nullif(stddev_pop(ra) * stddev_pop(rp), 0)", "bias": "avg(pred - actual)", "pred_std": "stddev_pop(pred)", "price_mae": "avg(abs(close * exp(pred) - close * exp(actual)))",
    "price_rmse": "sqrt(avg((close * exp(pred) - close * exp(actual)) ** 2))", "price_mape": "avg(abs((close * exp(pred) - close * exp(actual)) / (close * exp(actual))))",
}
_FOLD_MAE = PRED + ", f AS (SELECT series, model, fold, round(avg(abs(pred - actual)), 9) AS mae FROM preds GROUP BY ALL), won AS (SELECT *, (first(model) OVER (PARTITION BY series, fold ORDER BY mae, model) = model)::INT AS w FROM f), summary AS (SELECT series, model, avg(mae) AS mean_mae, stddev_pop(mae) AS std_mae, max(mae) AS worst_mae, sum(w)::BIGINT AS folds_won, count(*) AS folds FROM won GROUP BY ALL)"


def _boot(source: str, key: str, columns: list[str], resamples: int, block: int, circular: bool = False) -> str:
    """CTEs src (from ``source``), draws(key, resample, rows, columns): written without prefix sums."""
    a, b, c, m = resampling.HASH
    starts = "rows" if circular else f"greatest(rows - {block} + 1, 1)"
    hashed = f"((((resample * {a} + block * {b} + {c}) % {m}) * 48271 + resample * 7 + block) % {m}) % ({starts})"
    place = "(s + i) % rows" if circular else "s + i"
    return f"""src AS (SELECT {key} AS key, {", ".join(columns)}, row_number() OVER (PARTITION BY {key} ORDER BY t) - 1 AS ix FROM {source}), sizes AS (SELECT key, count(*) AS rows FROM src GROUP BY key),
grid AS (SELECT key, rows, resample, block, {hashed} AS s FROM (SELECT *, unnest(range(0, (rows + {block - 1}) // {block})) AS block FROM (SELECT *, unnest(range(0, {resamples})) AS resample FROM sizes))),
places AS (SELECT key, rows, resample, {place} AS ix FROM (SELECT *, unnest(range(0, least({block}, rows - block * {block}))) AS i FROM grid)),
draws AS (SELECT key, resample, any_value(rows) AS rows, {", ".join(f"sum({x}) AS {x}" for x in columns)} FROM places JOIN src USING (key, ix) GROUP BY key, resample)"""


def _interval(key: str, column: str) -> str:
    return f"SELECT key AS {key}, {r('mean', 'mean')}, {rs({'low': f'quantile_cont({column} / rows, 0.025)', 'high': f'quantile_cont({column} / rows, 0.975)', 'p_positive': f'avg(({column} > 0)::INT)'})} FROM draws JOIN (SELECT key, avg({column}) AS mean FROM src GROUP BY key) USING (key) GROUP BY key, mean"


_HALVES = "[" + ", ".join(str(list(h)) for h in combinations(range(8), 4)) + "]"
_COMBOS = "[" + ", ".join(str(list(h)) for h in combinations(range(6), 2)) + "]"
QUERIES = {f.__name__: f for f in (chronological_split, walk_forward_roles, calendar_folds, locked_tail_folds, combinatorial_roles, leakage_report, coverage_gate, forecast_metrics, direction_metrics, turnover, candidate_summary, selection_gate, threshold_coverage_wilson, regime_labels, strategy_returns, sharpe_moments, pbo_cscv, block_bootstrap, circular_bootstrap, conditional_bootstrap, holm_adjusted, stratified_bootstrap, deflated_sharpe, robustness_gates)}
ORACLES = {
    "chronological_split": f"""WITH {PRED}, b AS (SELECT series, min(t) FILTER (n = floor(rows * 0.7) + 1) AS bv, min(t) FILTER (n = floor(rows * (0.7::DOUBLE + 0.15::DOUBLE)) + 1) AS bt FROM numbered GROUP BY series)
      SELECT series, t, CASE WHEN t >= bt THEN 'test' WHEN t >= bv THEN CASE WHEN greatest(t + 3600, target_t) < bt THEN 'validation' END WHEN greatest(t + 3600, target_t) < bv THEN 'train' END AS split FROM lab JOIN b USING (series)""",
    "walk_forward_roles": f"""WITH {PRED}, sizes AS (SELECT series, rows, rows // 2 AS head, (rows - rows // 2) // 4 AS size FROM numbered GROUP BY ALL), f AS (SELECT *, unnest(range(1, 5)) AS fold FROM sizes),
      bounds AS (SELECT f.series, fold, min(t) FILTER (n = head + size * (fold - 1) + 1) AS a, CASE WHEN fold < 4 THEN min(t) FILTER (n = head + size * fold + 1) END AS b FROM f JOIN numbered USING (series) GROUP BY f.series, fold),
      m AS (SELECT lab.series, t, fold::INT AS fold, CASE WHEN t >= a AND (b IS NULL OR t < b) THEN 'validation' WHEN target_t < a AND t >= a - 360 * 3600 THEN 'train' END AS role FROM lab JOIN bounds USING (series)) SELECT * FROM m WHERE role IS NOT NULL""",
    "calendar_folds": f"WITH {_CAL} SELECT series, t, fold, role FROM kept SEMI JOIN (SELECT series, fold FROM kept GROUP BY ALL HAVING count(*) FILTER (role = 'train') >= 50) USING (series, fold)",
    "locked_tail_folds": f"""WITH {PRED}, s AS (SELECT *, rows - greatest(30, ceil(rows * 0.2))::BIGINT AS rest FROM numbered), f AS (SELECT *, rest // 5 AS size, unnest(range(0, 5)) AS fold FROM s),
      g AS (SELECT *, CASE WHEN fold = 0 THEN rest + 1 ELSE rest - size * (5 - fold) + 1 END AS lo, CASE WHEN fold = 0 THEN rows ELSE rest - size * (4 - fold) END AS hi FROM f),
      h AS (SELECT *, min(t) FILTER (n = lo) OVER (PARTITION BY series, fold) AS start FROM g), m AS (SELECT series, t, fold::INT AS fold, CASE WHEN n BETWEEN lo AND hi THEN CASE WHEN fold = 0 THEN 'test' ELSE 'validation' END WHEN n < lo AND target_t < start THEN 'train' END AS role FROM h)
      SELECT * FROM m WHERE role IS NOT NULL""",
    "combinatorial_roles": f"""WITH {PRED}, dealt AS (SELECT *, ntile(6) OVER (PARTITION BY series ORDER BY t) - 1 AS g FROM numbered), ends AS (SELECT series, g, min(t) AS lo, max(target_t) AS hi, max(n) AS last FROM dealt GROUP BY series, g),
      combos AS (SELECT unnest(range(0, 15)) AS split_id, unnest({_COMBOS}) AS tests), x AS (SELECT d.series, d.t, d.n, d.target_t, d.g, split_id, tests FROM dealt d, combos),
      y AS (SELECT x.series, x.t, x.split_id, bool_or(x.g = e.g) AS own, bool_or(x.t <= e.hi AND x.target_t >= e.lo) AS over, bool_or(x.n > e.last AND x.n <= e.last + 24) AS late FROM x JOIN ends e ON x.series = e.series AND list_contains(x.tests, e.g) GROUP BY x.series, x.t, x.split_id)
      SELECT series, split_id::INT AS split_id, CASE WHEN own THEN 'test' WHEN over THEN 'purged' WHEN late THEN 'embargoed' ELSE 'train' END AS role, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM y GROUP BY ALL""",
    "leakage_report": f"""WITH {PRED}, s AS (SELECT *, CASE WHEN t % 7 = 0 THEN 'train' WHEN t < 1705800000 THEN 'train' WHEN t < 1706200000 THEN 'validation' ELSE 'test' END AS split FROM lab),
      e AS (SELECT *, min(t) FILTER (split = 'validation') OVER (PARTITION BY series) AS v, min(t) FILTER (split = 'test') OVER (PARTITION BY series) AS x FROM s)
      SELECT series, count(*) AS rows, count(*) FILTER (target_t <> t + 3600) AS wrong_clock, count(*) FILTER ((split = 'train' AND target_t >= v) OR (split = 'validation' AND target_t >= x)) AS late_labels, count(*) - count(DISTINCT t) AS shared_times FROM e GROUP BY series""",
    "coverage_gate": f"""WITH {_CAL}, p AS (SELECT series, fold, role, avg((actual > 0)::INT) AS share, sum((actual > 0)::INT)::BIGINT AS present FROM kept SEMI JOIN (SELECT series, fold FROM kept GROUP BY ALL HAVING count(*) FILTER (role = 'train') >= 1) USING (series, fold) GROUP BY ALL)
      SELECT series, fold, role, {r("share", "share")}, present, concat_ws(',', CASE WHEN share < 0.5 THEN 'LOW_SHARE' END, CASE WHEN present < 60 THEN 'FEW_ROWS' END) AS failures FROM p""",
    "forecast_metrics": f"""WITH {PRED}, k AS (SELECT *, rank() OVER (PARTITION BY series, model, fold ORDER BY actual) + (count(*) OVER (PARTITION BY series, model, fold, actual) - 1) / 2.0 AS ra,
      rank() OVER (PARTITION BY series, model, fold ORDER BY pred) + (count(*) OVER (PARTITION BY series, model, fold, pred) - 1) / 2.0 AS rp FROM preds) SELECT series, model, fold, count(*) AS n, {rs(_METRICS)} FROM k GROUP BY series, model, fold""",
    "direction_metrics": f"""WITH {PRED} SELECT series, model, {rs({"mae": "avg(abs(pred - actual))", "sign_accuracy": "avg((sign(pred) = sign(actual))::INT)", "balanced_accuracy": "(avg(CASE WHEN actual > 0 THEN (pred > 0)::INT END) + avg(CASE WHEN actual < 0 THEN (pred < 0)::INT END)) / 2"})},
      CASE WHEN coalesce(avg(CASE WHEN actual <> 0 THEN (actual > 0)::INT END), 1) >= 0.5 THEN 1 ELSE -1 END AS majority_sign FROM preds GROUP BY series, model""",
    "turnover": f"""WITH {PRED}, q AS (SELECT *, sign(pred) AS p, coalesce(lag(sign(pred)) OVER (PARTITION BY series, model, fold ORDER BY t), 0) AS b FROM preds)
      SELECT series, model, {rs({"turnover_units": "sum(abs(p - b))", "flip_rate": "avg((p * b < 0)::INT)", "gross_return": "sum(p * actual)", "break_even_bps": "sum(p * actual) / nullif(sum(abs(p - b)), 0) * 10000"})} FROM q GROUP BY series, model""",
    "candidate_summary": f"WITH {_FOLD_MAE} SELECT series, model, {rs({x: x for x in ('mean_mae', 'std_mae', 'worst_mae')})}, folds_won, folds, row_number() OVER (PARTITION BY series ORDER BY mean_mae, std_mae, model)::INT AS place FROM summary",
    "selection_gate": f"""WITH {_FOLD_MAE}, j AS (SELECT *, max(mean_mae) FILTER (model = 'previous') OVER (PARTITION BY series) AS base FROM summary), g AS (SELECT *, mean_mae < base AND folds_won >= 2 AND model <> 'previous' AS passes FROM j)
      SELECT series, model, {r("1 - mean_mae / base", "improvement")}, passes, coalesce(arg_min(model, (mean_mae, model)) FILTER (passes) OVER (PARTITION BY series), 'previous') AS chosen FROM g""",
    "threshold_coverage_wilson": f"""WITH {PRED}, own AS (SELECT * FROM preds WHERE model = 'previous'), c AS (SELECT series, unnest([0.25, 0.5, 0.75])::DOUBLE AS coverage, unnest(quantile_cont(abs(pred), [0.75, 0.5, 0.25])) AS threshold FROM own GROUP BY series),
      k AS (SELECT series, coverage, threshold, count(*) FILTER (abs(pred) >= threshold AND actual <> 0) AS kept, count(*) FILTER (abs(pred) >= threshold AND actual <> 0 AND sign(pred) = sign(actual)) AS hits FROM own JOIN c USING (series) GROUP BY ALL)
      SELECT series, {rs({"coverage": "coverage", "threshold": "threshold"})}, kept, hits, {r("(hits / kept + 1.959963984540054 ** 2 / (2 * kept) - 1.959963984540054 * sqrt((hits / kept) * (1 - hits / kept) / kept + 1.959963984540054 ** 2 / (4 * kept * kept))) / (1 + 1.959963984540054 ** 2 / kept)", "wilson")} FROM k""",
    "regime_labels": f"""WITH {PRED}, a AS (SELECT *, ln(close) - ln({lag("close", 1)}) AS ret FROM bars), f AS (SELECT series, t, {roll("stddev_pop", "ret", 24, base_least(24))} AS v, close / ({roll("avg", "close", 24, base_least(24))}) - 1 AS m FROM a),
      q AS (SELECT series, quantile_cont(v, 0.67) AS qv, quantile_cont(abs(m), 0.67) AS qm FROM f WHERE t < 1705000000 GROUP BY series)
      SELECT series, CASE WHEN v IS NOT NULL AND m IS NOT NULL THEN CASE WHEN v >= qv THEN 'HIGH_VOL' WHEN abs(m) >= qm AND m > 0 THEN 'TREND_UP' WHEN abs(m) >= qm AND m < 0 THEN 'TREND_DOWN' ELSE 'RANGE' END END AS regime, count(*) AS n FROM f JOIN q USING (series) GROUP BY ALL""",
    "strategy_returns": f"WITH {PRED} SELECT series, model, t, {r('ret', 'ret')} FROM strategies",
    "sharpe_moments": f"""WITH {PRED}, m AS (SELECT *, avg(ret) OVER (PARTITION BY series, model) AS mu FROM strategies) SELECT series, model, count(*) AS n,
      {rs({"sharpe": "avg(ret) / stddev_samp(ret)", "skew": "avg((ret - mu) ** 3) / avg((ret - mu) ** 2) ** 1.5", "kurtosis": "avg((ret - mu) ** 4) / avg((ret - mu) ** 2) ** 2"})} FROM m GROUP BY series, model""",
    "pbo_cscv": f"""WITH {PRED}, b AS (SELECT *, ntile(8) OVER (PARTITION BY series, model ORDER BY t) - 1 AS block FROM strategies), halves AS (SELECT unnest(range(0, 70)) AS split_id, unnest({_HALVES}) AS ins),
      s AS (SELECT series, model, split_id, round(coalesce(avg(ret) FILTER (list_contains(ins, block)) / nullif(stddev_samp(ret) FILTER (list_contains(ins, block)), 0), 0), 10) AS i, round(coalesce(avg(ret) FILTER (NOT list_contains(ins, block)) / nullif(stddev_samp(ret) FILTER (NOT list_contains(ins, block)), 0), 0), 10) AS o FROM b, halves GROUP BY series, model, split_id),
      k AS (SELECT *, rank() OVER (PARTITION BY series, split_id ORDER BY o) + (count(*) OVER (PARTITION BY series, split_id, o) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY series, split_id) AS m, row_number() OVER (PARTITION BY series, split_id ORDER BY i DESC, model) AS best FROM s),
      l AS (SELECT series, ln((rk / (m + 1)) / (1 - rk / (m + 1))) AS logit FROM k WHERE best = 1) SELECT series, count(*) AS splits, {rs({"pbo": "avg((logit <= 0)::INT)", "mean_logit": "avg(logit)"})} FROM l GROUP BY series""",
    "block_bootstrap": f"""WITH {PRED}, w AS (SELECT series, t, max(abs(pred - actual)) FILTER (model = 'previous') - max(abs(actual)) FILTER (model = 'zero') AS gain FROM preds GROUP BY series, t), {_boot("w", "series", ["gain"], 200, 24)} {_interval("series", "gain")}""",
    "circular_bootstrap": f"WITH {PRED}, w AS (SELECT series || '|' || (t // {FOLD}) AS stratum, t, ret FROM strategies WHERE model = 'drift'), {_boot('w', 'stratum', ['ret'], 100, 24, True)} {_interval('stratum', 'ret')}",
    "conditional_bootstrap": f"""WITH {PRED}, w AS (SELECT series, t, (abs(pred) > 0.5)::INT::DOUBLE AS chosen, (abs(pred) > 0.5 AND sign(pred) = sign(actual))::INT::DOUBLE AS hit FROM preds WHERE model = 'previous'), {_boot("w", "series", ["hit", "chosen"], 200, 24)}
      SELECT key AS series, count(*) AS resamples, {rs({"low": "quantile_cont(hit / chosen, 0.025)", "high": "quantile_cont(hit / chosen, 0.975)"})} FROM draws WHERE chosen > 0 GROUP BY key""",
    "holm_adjusted": f"""WITH {PRED}, w AS (SELECT series || '|' || model AS sm, t, ret - avg(ret) OVER (PARTITION BY series, model) AS x FROM strategies), {_boot("w", "sm", ["x"], 200, 24)},
      mu AS (SELECT series, model, series || '|' || model AS key, avg(ret) AS mean FROM strategies GROUP BY series, model), p AS (SELECT series, model, mean, (1 + sum((round(x / rows, 12) >= round(mean, 12))::INT)) / 201.0 AS p FROM draws JOIN mu USING (key) GROUP BY series, model, mean),
      st AS (SELECT *, least(1, (count(*) OVER (PARTITION BY series) - row_number() OVER (PARTITION BY series ORDER BY p, model) + 1) * p) AS step FROM p)
      SELECT series, model, {rs({"mean": "mean", "p": "p", "holm_p": "max(step) OVER (PARTITION BY series ORDER BY p, model ROWS UNBOUNDED PRECEDING)"})} FROM st""",
}


def _phi(z: str) -> str:
    """The normal distribution function by Simpson's rule over 2000 steps."""
    x = f"least(abs({z}), 9) * i / 2000.0"
    return f"(SELECT 0.5 + sign({z}) * least(abs({z}), 9) / 6000 / sqrt(2 * pi()) * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(({x}) ** 2) / 2)) FROM range(0, 2001) x(i))"


_TRIALS = sum(STAGES.values())
_BEST = (1 - 0.5772156649015329) * NormalDist().inv_cdf(1 - 1 / _TRIALS) + 0.5772156649015329 * NormalDist().inv_cdf(1 - 1 / (_TRIALS * math.e))
_DSR = f"""mm AS (SELECT *, avg(ret) OVER (PARTITION BY series, model) AS mu FROM strategies), mo AS (SELECT series, model, count(*) AS n, avg(ret) / stddev_samp(ret) AS sharpe, avg((ret - mu) ** 3) / avg((ret - mu) ** 2) ** 1.5 AS skew, avg((ret - mu) ** 4) / avg((ret - mu) ** 2) ** 2 AS kurtosis FROM mm GROUP BY series, model),
sp AS (SELECT series, count(*) AS strategies, avg(sharpe) AS trial_mean, coalesce(stddev_samp(sharpe), 0) AS trial_std FROM mo GROUP BY series),
zz AS (SELECT mo.*, strategies, trial_mean, trial_std, CASE WHEN trial_std > 0 THEN trial_std * {_BEST!r}::DOUBLE ELSE 0 END AS benchmark FROM mo JOIN sp USING (series)),
zs AS (SELECT *, (sharpe - benchmark) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) AS z FROM zz), dsr AS (SELECT *, {_phi("z")} AS probability FROM zs)"""
_STRATA = f"""w0 AS (SELECT series, fold, t, actual, max(abs(pred - actual)) FILTER (model = 'zero') AS z, max(abs(pred - actual)) FILTER (model = 'previous') AS p, max(abs(pred - actual)) FILTER (model = 'drift') AS q, max(pred) FILTER (model = 'previous') AS pred FROM preds GROUP BY series, fold, t, actual),
w AS (SELECT series, series || '|' || fold AS stratum, t, z - p AS gain_previous, z - q AS gain_drift, (abs(pred) > 0.5)::INT::DOUBLE AS chosen, (abs(pred) > 0.5 AND sign(pred) = sign(actual))::INT::DOUBLE AS hit FROM w0)"""
_STATS = {"gain_previous": "sum(gain_previous) / sum(rows)", "gain_drift": "sum(gain_drift) / sum(rows)", "hit_rate": "CASE WHEN sum(chosen) > 0 THEN sum(hit) / sum(chosen) END"}
ORACLES |= {
    "stratified_bootstrap": f"""WITH {PRED}, {_STRATA}, {_boot("w", "stratum", ["gain_previous", "gain_drift", "chosen", "hit"], 2000, 24, True)},
      total AS (SELECT split_part(key, '|', 1) AS series, resample, {", ".join(f"{x} AS {n}" for n, x in _STATS.items())} FROM draws GROUP BY 1, 2),
      seen AS (SELECT series, {", ".join(f"{x.replace('sum(rows)', 'count(*)')} AS {n}" for n, x in _STATS.items())} FROM w GROUP BY series),
      l AS ({" UNION ALL ".join(f"SELECT series, '{n}' AS statistic, {n} AS v FROM total" for n in _STATS)}), o AS ({" UNION ALL ".join(f"SELECT series, '{n}' AS statistic, {n} AS observed FROM seen" for n in _STATS)})
      SELECT series, statistic, {rs({"observed": "any_value(observed)", "low": "quantile_cont(v, 0.025)", "high": "quantile_cont(v, 0.975)", "p_above": "avg((v > 0)::INT)"})} FROM l JOIN o USING (series, statistic) GROUP BY series, statistic""",
    "deflated_sharpe": f"WITH {PRED}, {_DSR} SELECT series, model, n, strategies, {_TRIALS}::BIGINT AS counted_trials, {rs({x: x for x in ('sharpe', 'trial_mean', 'trial_std', 'benchmark', 'z', 'probability')})} FROM dsr",
    "robustness_gates": f"""WITH {PRED}, {_DSR}, pb AS ({ORACLES["pbo_cscv"].removeprefix(f"WITH {PRED}, ").join(("WITH ", ""))}), hm AS ({ORACLES["holm_adjusted"].removeprefix(f"WITH {PRED}, ").join(("WITH ", ""))}),
      fm AS (SELECT series, model, fold, round(avg(abs(pred - actual)), 9) AS mae FROM preds GROUP BY ALL), wn AS (SELECT a.series, a.model, avg((a.mae < b.mae)::INT) AS better_fraction FROM fm a JOIN fm b ON a.series = b.series AND a.fold = b.fold AND b.model = 'zero' GROUP BY ALL),
      g AS (SELECT series, model, probability, better_fraction, pbo, mean, holm_p, round(better_fraction, 9) >= round(2 / 3, 9) AS gate_splits, pbo < 0.2 AS gate_pbo, probability >= 0.95 AS gate_dsr, holm_p < 0.05 AND mean > 0 AS gate_holm FROM dsr JOIN wn USING (series, model) JOIN pb USING (series) JOIN hm USING (series, model))
      SELECT series, model, {rs({x: x for x in ("probability", "better_fraction", "pbo", "mean", "holm_p")})}, gate_splits, gate_pbo, gate_dsr, gate_holm, CASE WHEN gate_splits AND gate_pbo AND gate_dsr AND gate_holm THEN 'ROBUST_AFTER_MULTIPLE_TESTING' ELSE 'NOT_PROVEN_AFTER_MULTIPLE_TESTING' END AS evidence FROM g""",
}
