"""Nested stacking, paired promotion and family ablation over base features, and SQL for models by walk-forward."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import features, targets
from ..plans import stacking
from ..plans.stacking import Base, Combinatorial, Inner, WalkForward
from ._sql import line, r, ridge, roll, rounded, rs
from .evaluation import _boot
from .features import _HOURLY, _PRICE, bars_of

BASES = (Base("returns", ("log_return_1h", "log_return_6h"), 10.0), Base("shape", ("candle_body_pct", "close_location_value"), 3.0))
FAMILIES = {"returns": ("log_return_1h",), "momentum": ("log_return_6h",), "candle": ("candle_body_pct",), "location": ("close_location_value",), "range": ("log_hl_range",), "clock": ("hour_sin",), "volatility": ("realized_vol_24h",)}
NAMES = [f for own in FAMILIES.values() for f in own]
SUBSETS = stacking.family_subsets(FAMILIES)
RESAMPLES, BLOCK = 2000, 24


def frame(spark, d):
    bars = bars_of(spark, d)
    labels = targets.next_bar(bars).where("target_t IS NOT NULL").select("series", "t", "close", "target_t", F.col("target_log_return").alias("actual"))
    return features.base_features(bars).select("series", "t", *NAMES).join(labels, ["series", "t"])


def nested_stacking(spark, d):
    done = stacking.nested_predictions(frame(spark, d), BASES, WalkForward(4, 0.5), Inner(3, 0.55))
    return rounded(done.select("series", "model", "fold", "t", "actual", "pred"))


def combinatorial_stacking(spark, d):
    done = stacking.nested_predictions(frame(spark, d), BASES, Combinatorial(6, 2, 24), Inner(3, 0.55))
    error = F.abs(F.col("pred") - F.col("actual"))
    mae = {m: F.avg(F.when(F.col("model") == m, error)).alias(f"{m}_mae") for m in ("returns", "stack")}
    return rounded(done.groupBy("series", "fold").agg(F.count(F.when(F.col("model") == "stack", 1)).alias("n"), *mae.values()).where("n > 0"))


def feature_set_promotion(spark, d):
    sets = {"base": NAMES[:2], "enhanced": NAMES[:2] + ["hour_sin", "realized_vol_24h"]}
    done = stacking.paired_comparison(stacking.subset_predictions(frame(spark, d), sets, WalkForward()), [("base", "enhanced")], RESAMPLES, BLOCK)
    return rounded(done)


def family_ablation(spark, d):
    predictions = stacking.subset_predictions(frame(spark, d), SUBSETS, WalkForward())
    return rounded(stacking.ablation(predictions, list(FAMILIES), RESAMPLES, BLOCK))


#: Labelled rows with all features of this module: feats.
FEATS = _HOURLY + f""", named AS (SELECT series, t, close, lead(t) OVER w AS due, lead(close) OVER w AS nc, ln(close) - ln(p1) AS log_return_1h,
  ln(close) - ln(max(close) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN 21600 PRECEDING AND 21600 PRECEDING)) AS log_return_6h, {", ".join(f"{_PRICE[x]} AS {x}" for x in ("candle_body_pct", "close_location_value", "log_hl_range"))},
  sin(2 * pi() * (t // 3600 % 24) / 24) AS hour_sin, {roll("stddev_pop", "ret", 24, 12)} AS realized_vol_24h FROM hourly WINDOW w AS (PARTITION BY series ORDER BY t)),
feats AS (SELECT series, t, t + 3600 AS end_t, close, ln(nc) - ln(close) AS actual, {", ".join(f"coalesce({x}, 0) AS {x}" for x in NAMES)} FROM named WHERE due = t + 3600),
numbered AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) AS n, count(*) OVER (PARTITION BY series) AS rows FROM feats)"""

_WALK = """heads AS (SELECT DISTINCT series, rows, rows // 2 AS head, (rows - rows // 2) // 4 AS size FROM numbered), folds AS (SELECT *, unnest(range(1, 5)) AS fold FROM heads),
bounds AS (SELECT f.series, fold, min(t) FILTER (n = head + size * (fold - 1) + 1) AS a, CASE WHEN fold < 4 THEN min(t) FILTER (n = head + size * fold + 1) END AS b FROM folds f JOIN numbered USING (series) GROUP BY f.series, fold),
roles AS (SELECT f.*, fold::INT AS fold, CASE WHEN t >= a AND (b IS NULL OR t < b) THEN 'test' WHEN end_t < a THEN 'train' END AS role FROM feats f JOIN bounds USING (series))"""
_COMBOS = "[" + ", ".join(str(list(h)) for h in combinations(range(6), 2)) + "]"
_CPCV = f"""dealt AS (SELECT *, ntile(6) OVER (PARTITION BY series ORDER BY t) - 1 AS g FROM numbered), ends AS (SELECT series, g, min(t) AS lo, max(end_t) AS hi, max(n) AS last FROM dealt GROUP BY series, g),
combos AS (SELECT unnest(range(0, 15)) AS fold, unnest({_COMBOS}) AS tests), x AS (SELECT d.series, d.t, d.n, d.end_t, d.g, fold, tests FROM dealt d, combos),
y AS (SELECT x.series, x.t, x.fold, bool_or(x.g = e.g) AS own, bool_or(x.t <= e.hi AND x.end_t >= e.lo) AS over, bool_or(x.n > e.last AND x.n <= e.last + 24) AS late FROM x JOIN ends e ON x.series = e.series AND list_contains(x.tests, e.g) GROUP BY x.series, x.t, x.fold),
roles AS (SELECT f.*, fold::INT AS fold, CASE WHEN own THEN 'test' WHEN over OR late THEN 'gone' ELSE 'train' END AS role FROM y JOIN feats f USING (series, t))"""


def _nested() -> str:
    """CTEs from roles to made(series, fold, t, close, actual, returns, shape, stack)."""
    inner = {b.name: ridge(f"i_{b.name}", "itrain", "series, fold, i", list(b.features), "actual", b.alpha) for b in BASES}
    outer = {b.name: ridge(f"o_{b.name}", "tr", "series, fold", list(b.features), "actual", b.alpha) for b in BASES}
    joined = " ".join(f"JOIN i_{b.name} USING (series, fold, i)" for b in BASES)
    final = " ".join(f"JOIN o_{b.name} USING (series, fold)" for b in BASES)
    names = [b.name for b in BASES]
    return f"""tr AS (SELECT *, row_number() OVER (PARTITION BY series, fold ORDER BY t) AS k, count(*) OVER (PARTITION BY series, fold) AS m FROM roles WHERE role = 'train'),
cuts AS (SELECT series, fold, i, min(t) FILTER (k = head + size * i + 1) AS u, min(t) FILTER (i < 2 AND k = head + size * (i + 1) + 1) AS v
  FROM (SELECT *, (m - head) // 3 AS size, unnest([0, 1, 2]) AS i FROM (SELECT *, floor(m * 0.55::DOUBLE)::BIGINT AS head FROM tr)) WHERE size > 0 GROUP BY series, fold, i),
itrain AS (SELECT tr.*, i FROM tr JOIN cuts USING (series, fold) WHERE end_t < u),
ivalid AS (SELECT tr.*, i FROM tr JOIN cuts USING (series, fold) WHERE t >= u AND (v IS NULL OR t < v)),
{", ".join(inner.values())}, {", ".join(outer.values())},
level AS (SELECT ivalid.series, ivalid.fold, actual, {", ".join(f"{line(f'i_{b.name}', list(b.features), 'ivalid')} AS {b.name}" for b in BASES)} FROM ivalid {joined}),
{ridge("meta", "level", "series, fold", names, "actual", 1.0)},
based AS (SELECT series, fold, t, close, actual, {", ".join(f"{line(f'o_{b.name}', list(b.features), 'roles')} AS {b.name}" for b in BASES)} FROM roles {final} WHERE role = 'test'),
made AS (SELECT based.*, {line("meta", names, "based")} AS stack FROM based JOIN meta USING (series, fold))"""


def _subsets(sets: dict) -> str:
    """CTEs from roles to preds(series, fold, t, actual, <number of the set>)."""
    tables = {name: f"r{i}" for i, name in enumerate(sets)}
    parts = [ridge(tables[name], "tr", "series, fold", list(own), "actual", 10.0) for name, own in sets.items()]
    joined = " ".join(f"JOIN {t} USING (series, fold)" for t in tables.values())
    lines = ", ".join(f"{line(tables[name], list(own), 'roles')} AS p{i}" for i, (name, own) in enumerate(sets.items()))
    return f"tr AS (SELECT * FROM roles WHERE role = 'train'), {', '.join(parts)}, preds AS (SELECT series, fold, t, actual, {lines} FROM roles {joined} WHERE role = 'test')"


def _compared(sets: list[str], pairs: list[tuple[str, str]]) -> str:
    """CTEs from preds to compared(series, base, candidate, ..., evidence)."""
    error = lambda m: f"abs(p{sets.index(m)} - actual)"
    rows = " UNION ALL ".join(f"SELECT series, fold, t, '{a}' AS base, '{b}' AS candidate, {error(a)} AS eb, {error(b)} AS ec FROM preds" for a, b in pairs)
    return f"""paired AS (SELECT *, eb - ec AS gain, series || '|' || base || '|' || candidate AS kk FROM ({rows})),
by_fold AS (SELECT kk, fold, avg(eb) AS b, avg(ec) AS c FROM paired GROUP BY kk, fold), wins AS (SELECT kk, count(*) AS folds, sum((round(c, 12) < round(b, 12))::INT)::BIGINT AS better_folds FROM by_fold GROUP BY kk),
{_boot("paired", "kk", ["gain"], RESAMPLES, BLOCK)},
ci AS (SELECT key AS kk, quantile_cont(gain / rows, 0.025) AS low, quantile_cont(gain / rows, 0.975) AS high, avg((gain > 0)::INT) AS p_positive FROM draws GROUP BY key),
joint AS (SELECT any_value(series) AS series, any_value(base) AS base, any_value(candidate) AS candidate, avg(eb) AS base_mae, avg(ec) AS candidate_mae, any_value(folds) AS folds, any_value(better_folds) AS better_folds, avg(gain) AS improvement, any_value(low) AS low, any_value(high) AS high, any_value(p_positive) AS p_positive
  FROM paired JOIN wins USING (kk) JOIN ci USING (kk) GROUP BY kk),
compared AS (SELECT *, CASE WHEN round(improvement, 12) > 0 AND better_folds >= 4 AND round(low, 12) > 0 AND p_positive >= 0.95 THEN 'STRONG_EVIDENCE' WHEN round(improvement, 12) > 0 AND better_folds >= 3 AND p_positive >= 0.8 THEN 'PROMISING_NOT_CONCLUSIVE' ELSE 'NO_STABLE_EVIDENCE' END AS evidence FROM joint)"""


_PAIRS = [*(("base", f"add:{f}") for f in FAMILIES), *((f"drop:{f}", "all") for f in FAMILIES), *(("all", f"drop:{f}") for f in FAMILIES)]
_PROMOTED = {"base": NAMES[:2], "enhanced": NAMES[:2] + ["hour_sin", "realized_vol_24h"]}
QUERIES = {f.__name__: f for f in (nested_stacking, combinatorial_stacking, feature_set_promotion, family_ablation)}
ORACLES = {
    "nested_stacking": f"WITH {FEATS}, {_WALK}, {_nested()} SELECT series, model, fold, t, {r('actual', 'actual')}, {r('pred', 'pred')} FROM (UNPIVOT made ON returns, shape, stack INTO NAME model VALUE pred)",
    "combinatorial_stacking": f"WITH {FEATS}, {_CPCV}, {_nested()} SELECT series, fold, count(*) AS n, {rs({f'{m}_mae': f'avg(abs({m} - actual))' for m in ('returns', 'stack')})} FROM made GROUP BY series, fold",
    "feature_set_promotion": f"""WITH {FEATS}, {_WALK}, {_subsets(_PROMOTED)}, {_compared(list(_PROMOTED), [("base", "enhanced")])}
      SELECT series, base, candidate, {rs({x: x for x in ("base_mae", "candidate_mae", "improvement", "low", "high", "p_positive")})}, folds, better_folds, evidence, evidence <> 'NO_STABLE_EVIDENCE' AS promote FROM compared""",
    "family_ablation": f"""WITH {FEATS}, {_WALK}, {_subsets(SUBSETS)}, {_compared(list(SUBSETS), _PAIRS)},
      added AS (SELECT series, split_part(candidate, ':', 2) AS family, improvement AS added_gain, evidence AS added_evidence FROM compared WHERE base = 'base'),
      held AS (SELECT series, split_part(base, ':', 2) AS family, improvement AS kept_gain, evidence AS kept_evidence FROM compared WHERE candidate = 'all'),
      gone AS (SELECT series, split_part(candidate, ':', 2) AS family, evidence AS dropped_evidence FROM compared WHERE base = 'all')
      SELECT series, family, {rs({"added_gain": "added_gain", "kept_gain": "kept_gain"})}, added_evidence, kept_evidence, dropped_evidence, round(added_gain, 12) > 0 AND round(kept_gain, 12) > 0 AS helps, dropped_evidence <> 'NO_STABLE_EVIDENCE' AS harms
      FROM added JOIN held USING (series, family) JOIN gone USING (series, family)""",
}
