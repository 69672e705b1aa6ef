"""Feature library and labels over hourly bars of each event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as op
from ..operators import targets
from ..sources import tables as src
from ._sql import BARS, base_least, corr, cross_least, lag, lead, pos, r, roll, rounded, rs, shift


def bars_of(spark, d):
    return src.bars(spark, d).withColumn("quality", F.when(F.col("n_ticks") >= 2, "OK").otherwise("PARTIAL_SOURCE_HOUR"))


def one(spark, d, kind):
    return bars_of(spark, d).where(F.col("series") == kind)


def price_action(spark, d):
    return rounded(bars_of(spark, d).select("series", "t", *[x.alias(n) for n, x in op.price_action_columns().items()]))


def exact_lag_returns(spark, d):
    return rounded(bars_of(spark, d).select("series", "t", *[x.alias(n) for n, x in op.momentum_columns().items()]))


def rsi(spark, d):
    return rounded(op.rsi(bars_of(spark, d)))


def realized_vol(spark, d):
    return rounded(op.volatility(bars_of(spark, d)))


def trend_sma(spark, d):
    return rounded(op.trend(bars_of(spark, d)))


def temporal(spark, d):
    return rounded(op.temporal(bars_of(spark, d)))


def base_features(spark, d):
    return rounded(op.base_features(bars_of(spark, d)))


def next_bar_target(spark, d):
    return rounded(targets.decision_clock(targets.next_bar(bars_of(spark, d))).select("series", "t", "target_t", "target_log_return", "target_close", "decision_t", "target_close_t"))


def direct_targets(spark, d):
    return rounded(targets.direct(bars_of(spark, d)).select("series", "t", *[f"target_log_return_{n}h" for n in (4, 12, 24, 48, 720)]))


def target_quality(spark, d):
    return targets.with_target_quality(bars_of(spark, d)).select("series", "t", "quality", "target_quality", "strict")


def cross_asset_ratio(spark, d):
    lags, windows = (1, 3, 6, 12, 24, 72, 168), (24, 72, 168)
    done = op.relative(one(spark, d, "click"), op.auxiliary(one(spark, d, "view"), "x", lags, windows), "x", lags, lags, windows, base_minus_side=True, has_ratio=True)
    return rounded(done.drop("open", "high", "low", "close", "n_ticks", "quality"))


def cross_asset_index(spark, d):
    lags, windows = (1, 6, 24), (24, 72)
    done = op.relative(one(spark, d, "click"), op.auxiliary(one(spark, d, "signup"), "x", lags, windows, trends=True), "x", lags, (), windows, base_minus_side=True, with_ratio=False)
    return rounded(done.drop("open", "high", "low", "close", "n_ticks", "quality"))


def metal_complex(spark, d):
    return rounded(op.metal_like(one(spark, d, "click"), one(spark, d, "purchase"), one(spark, d, "error")).drop("open", "high", "low", "close", "n_ticks", "quality"))


def confirmed_subset(spark, d):
    return rounded(op.confirmed_subset(one(spark, d, "click"), one(spark, d, "purchase"), one(spark, d, "error")))


def hlc_features(spark, d):
    return rounded(op.hlc_features(bars_of(spark, d)))


_PRICE = {
    "candle_range_pct": "(high - low) / nullif(open, 0)", "candle_body_pct": "(close - open) / nullif(open, 0)", "upper_wick_pct": "(high - greatest(open, close)) / nullif(open, 0)",
    "lower_wick_pct": "(least(open, close) - low) / nullif(open, 0)", "close_location_value": "coalesce((close - low) / nullif(high - low, 0), 0.5)", "log_hl_range": "ln(high / low)",
}
_LAGS = (1, 3, 6, 12, 24, 72, 168)


def _momentum() -> str:
    parts = []
    for n in _LAGS:
        parts += [f"({lag('close', n)} IS NOT NULL)::INT AS has_exact_{n}h", r(f"ln(close) - ln({lag('close', n)})", f"log_return_{n}h")]
        if n > 1:
            parts.append(r(f"close / {lag('close', n)} - 1", f"momentum_{n}h"))
    return ", ".join(parts)


_HOURLY = BARS + f""", prior AS (SELECT *, {lag("close", 1)} AS p1 FROM bars),
hourly AS (SELECT *, ln(close) - ln(p1) AS ret, CASE WHEN p1 IS NOT NULL THEN greatest(close - p1, 0) END AS rise, CASE WHEN p1 IS NOT NULL THEN greatest(p1 - close, 0) END AS fall,
  greatest(high - low, abs(high - p1), abs(low - p1)) AS tr, {", ".join(f"{roll('avg', 'close', w, base_least(w))} AS sma_{w}" for w in op.TREND_WINDOWS)} FROM prior),
rsi0 AS (SELECT series, t, {roll("avg", "rise", 14, 7)} AS up, {roll("avg", "fall", 14, 7)} AS down FROM hourly)"""
_RSI = "CASE WHEN up = 0 AND down = 0 THEN 50 WHEN down = 0 AND up > 0 THEN 100 ELSE 100 - 100 / (1 + up / nullif(down, 0)) END"
_VOL = {f"realized_vol_{w}h": roll("stddev_pop", "ret", w, base_least(w)) for w in op.VOLATILITY_WINDOWS} | {"atr_pct_14h": f"({roll('avg', 'tr', 14, 7)}) / close"}
_TREND = {}
for _w in op.TREND_WINDOWS:
    _lo, _hi = roll("min", "close", _w, base_least(_w)), roll("max", "close", _w, base_least(_w))
    _TREND |= {f"close_vs_sma_{_w}h": f"close / nullif(sma_{_w}, 0) - 1", f"sma_slope_1h_{_w}h": f"sma_{_w} / nullif({lag(f'sma_{_w}', 1)}, 0) - 1", f"range_position_{_w}h": f"coalesce((close - ({_lo})) / nullif(({_hi}) - ({_lo}), 0), 0.5)"}
_CALENDAR = {"hour_sin": "sin(2 * pi() * (t // 3600 % 24) / 24)", "hour_cos": "cos(2 * pi() * (t // 3600 % 24) / 24)", "weekday_sin": "sin(2 * pi() * ((t // 86400 + 3) % 7) / 7)", "weekday_cos": "cos(2 * pi() * ((t // 86400 + 3) % 7) / 7)"}
_GAP = f"{r('(t - ' + shift('t', 1) + ') / 3600', 'gap_from_previous_hours')}, coalesce((t - {shift('t', 1)} = 3600)::INT, 0) AS is_contiguous_from_previous, (quality <> 'OK')::INT AS is_partial_source_hour"


def _aux(kind: str, lags, windows, trends=False) -> str:
    parts = [f"close AS x_close, {_PRICE['candle_range_pct']} AS x_candle_range_pct, {_PRICE['candle_body_pct']} AS x_candle_body_pct, (quality <> 'OK')::INT AS x_is_partial_source_hour"]
    for n in lags:
        parts.append(f"({lag('close', n)} IS NOT NULL)::INT AS x_has_exact_{n}h, ln(close) - ln({lag('close', n)}) AS x_log_return_{n}h")
    for w in windows:
        parts.append(f"{roll('stddev_pop', 'ret', w, cross_least(w))} AS x_realized_vol_{w}h")
        if trends:
            lo, hi, mean = (roll(f, "close", w, cross_least(w)) for f in ("min", "max", "avg"))
            parts.append(f"close / nullif(({mean}), 0) - 1 AS x_close_vs_sma_{w}h, coalesce((close - ({lo})) / nullif(({hi}) - ({lo}), 0), 0.5) AS x_range_position_{w}h")
    return f"SELECT t, {', '.join(parts)} FROM hourly WHERE series = '{kind}'"


def _joined(kind, lags, windows, trends=False):
    return f"{_HOURLY}, aux AS ({_aux(kind, lags, windows, trends)}), j AS (SELECT hourly.*, aux.* EXCLUDE (t), ln(x_close / close) AS lr FROM hourly LEFT JOIN aux USING (t) WHERE series = 'click')"


def _common(lags, windows):
    return f"series, t, coalesce(x_is_partial_source_hour, 0) AS x_is_partial_source_hour, (x_close IS NOT NULL)::INT AS x_has_exact_current, {rs({x: x for x in ('x_candle_range_pct', 'x_candle_body_pct')})}, " + ", ".join(f"coalesce(x_has_exact_{n}h, 0) AS x_has_exact_{n}h, {r(f'x_log_return_{n}h', f'x_log_return_{n}h')}" for n in lags) + ", " + ", ".join(f"{r(f'x_realized_vol_{w}h', f'x_realized_vol_{w}h')}, {r(corr('ret', 'x_log_return_1h', w, cross_least(w)), f'x_corr_{w}h')}" for w in windows)


def _ratio_sql() -> str:
    lags, windows = _LAGS, (24, 72, 168)
    more = ", ".join(f"{r(f'ln(close) - ln({lag("close", n)}) - x_log_return_{n}h', f'x_relative_return_{n}h')}, {r(f'lr - {lag("lr", n)}', f'x_log_ratio_change_{n}h')}, (lr IS NOT NULL AND {lag('lr', n)} IS NOT NULL)::INT AS x_ratio_has_exact_{n}h" for n in lags)
    return f"WITH {_joined('view', lags, windows)} SELECT {_common(lags, windows)}, {r('lr', 'log_x_ratio')}, {more} FROM j"


def _index_sql() -> str:
    lags, windows = (1, 6, 24), (24, 72)
    more = rs({f"x_{n}_{w}h": f"x_{n}_{w}h" for w in windows for n in ("close_vs_sma", "range_position")})
    return f"WITH {_joined('signup', lags, windows, True)} SELECT {_common(lags, windows)}, {more} FROM j"


def _metal_sql() -> str:
    lags = (1, 3, 6, 24)
    ctes, parts = [_HOURLY], []
    for p, kind in (("a", "purchase"), ("b", "error")):
        own = _aux(kind, lags, (24,)).replace("x_", f"{p}_")
        ctes.append(f"aux_{p} AS ({own})")
    ctes.append("j AS (SELECT hourly.*, aux_a.* EXCLUDE (t), aux_b.* EXCLUDE (t), ln(a_close / close) AS lr_a, ln(b_close / close) AS lr_b, ln(a_close / close) - ln(b_close / close) AS ab FROM hourly LEFT JOIN aux_a USING (t) LEFT JOIN aux_b USING (t) WHERE series = 'click')")
    for p in "ab":
        parts.append(f"({p}_close IS NOT NULL)::INT AS {p}_has_exact_current, {rs({f'{p}_{x}': f'{p}_{x}' for x in ('candle_range_pct', 'candle_body_pct', 'realized_vol_24h')})}, {r(f'lr_{p}', f'log_{p}_ratio')}")
        parts += [f"coalesce({p}_has_exact_{n}h, 0) AS {p}_has_exact_{n}h, {r(f'{p}_log_return_{n}h', f'{p}_log_return_{n}h')}, {r(f'{p}_log_return_{n}h - (ln(close) - ln({lag("close", n)}))', f'{p}_relative_return_{n}h')}" for n in lags]
        parts += [r(f"lr_{p} - {lag(f'lr_{p}', n)}", f"{p}_log_ratio_change_{n}h") for n in (6, 24)]
        parts += [r(corr("ret", f"{p}_log_return_1h", w, cross_least(w)), f"{p}_corr_{w}h") for w in (24, 72)]
    a, b = "a_log_return_1h", "b_log_return_1h"
    joint = {"log_a_b_ratio": "ab", "a_b_log_ratio_change_1h": f"ab - {lag('ab', 1)}", "complex_mean_return_1h": f"({a} + {b}) / 2", "complex_return_dispersion_1h": f"abs({a} - {b})", "complex_breadth_1h": f"(sign({a}) + sign({b})) / 2.0", "a_b_return_spread_1h": f"{a} - {b}"}
    return f"WITH {', '.join(ctes)} SELECT series, t, {', '.join(parts)}, (a_close IS NOT NULL AND b_close IS NOT NULL)::INT AS both_have_exact_current, {rs(joint)} FROM j"


def _confirmed_sql() -> str:
    auxes = ", ".join(f"aux_{p} AS ({_aux(k, (1, 6, 24), ()).replace('x_', f'{p}_')})" for p, k in (("a", "purchase"), ("b", "error")))
    names = {f"{p}_{x}": f"{p}_{x}" for p in "ab" for x in ("candle_range_pct", "candle_body_pct", "log_return_1h", "log_return_6h", "log_return_24h")}
    return f"WITH {_HOURLY}, {auxes} SELECT series, t, {rs(names)} FROM bars LEFT JOIN aux_a USING (t) LEFT JOIN aux_b USING (t) WHERE series = 'click'"


_HLC = {f"log_return_{k}": f"ln(close) - {shift('ln(close)', k)}" for k in (1, 2, 3, 6)} | {"range_pct": "rp", "close_location": "coalesce((close - low) / nullif(high - low, 0), 0.5)"}
for _w in (3, 6):
    _HLC |= {f"rolling_return_mean_{_w}": pos("avg", "r1", _w), f"rolling_return_std_{_w}": pos("stddev_samp", "r1", _w), f"rolling_range_mean_{_w}": pos("avg", "rp", _w)}

QUERIES = {f.__name__: f for f in (price_action, exact_lag_returns, rsi, realized_vol, trend_sma, temporal, base_features, next_bar_target, direct_targets, target_quality, cross_asset_ratio, cross_asset_index, metal_complex, confirmed_subset, hlc_features)}
ORACLES = {
    "price_action": f"WITH {BARS} SELECT series, t, {rs(_PRICE)} FROM bars",
    "exact_lag_returns": f"WITH {BARS} SELECT series, t, {_momentum()} FROM bars",
    "rsi": f"WITH {_HOURLY} SELECT series, t, {r(_RSI, 'rsi_14h')} FROM rsi0",
    "realized_vol": f"WITH {_HOURLY} SELECT series, t, {rs(_VOL)} FROM hourly",
    "trend_sma": f"WITH {_HOURLY} SELECT series, t, {rs(_TREND)} FROM hourly",
    "temporal": f"WITH {BARS} SELECT series, t, {rs(_CALENDAR)}, {_GAP} FROM bars",
    "base_features": f"WITH {_HOURLY} SELECT series, t, {rs(_PRICE)}, {_momentum()}, {r(_RSI, 'rsi_14h')}, {rs(_VOL)}, {rs(_TREND)}, {rs(_CALENDAR)}, {_GAP} FROM hourly JOIN rsi0 USING (series, t)",
    "next_bar_target": f"""WITH {BARS}, n AS (SELECT *, lead(t) OVER w = t + 3600 AS due, lead(close) OVER w AS nc FROM bars WINDOW w AS (PARTITION BY series ORDER BY t))
      SELECT series, t, CASE WHEN due THEN t + 3600 END AS target_t, {rs({"target_log_return": "CASE WHEN due THEN ln(nc) - ln(close) END", "target_close": "CASE WHEN due THEN nc END"})}, t + 3600 AS decision_t, t + 7200 AS target_close_t FROM n""",
    "direct_targets": f"WITH {BARS} SELECT series, t, {rs({f'target_log_return_{n}h': f'ln({lead("close", n)}) - ln(close)' for n in (4, 12, 24, 48, 720)})} FROM bars",
    "target_quality": f"WITH {BARS}, q AS (SELECT series, t, quality, {lead('quality', 1)} AS target_quality FROM bars) SELECT *, coalesce(quality = 'OK' AND target_quality = 'OK', false) AS strict FROM q",
    "cross_asset_ratio": _ratio_sql(),
    "cross_asset_index": _index_sql(),
    "metal_complex": _metal_sql(),
    "confirmed_subset": _confirmed_sql(),
    "hlc_features": f"WITH {BARS}, a AS (SELECT *, ln(close) - {shift('ln(close)', 1)} AS r1, (high - low) / close AS rp FROM bars) SELECT series, t, {rs(_HLC)} FROM a",
}
