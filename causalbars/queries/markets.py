"""Order books, forward bars, frozen models, spread scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import book, features, forward, linear, spread, targets
from ..sources import tables as src
from ._sql import BARS, line, r, ridge, rounded, rs, shift
from .features import bars_of


def snapshots(spark, d):
    """Books of each event type and three hours: cheap events bid, dear ones ask, quantity by user."""
    ticks = src.ticks(spark, d)
    keyed = ticks.select(F.col("series").alias("security"), (F.floor(F.col("t") / 10_800) * 10_800).cast("long").alias("t"), F.struct((F.col("price") + 100).alias("price"), (F.col("user_id") % 50 + 1).cast("double").alias("quantity"), "order_key").alias("x"))
    listed = keyed.groupBy("security", "t").agg(F.array_sort(F.collect_list("x")).alias("x"))
    half = F.floor(F.size("x") / 2).cast("int")
    plain = lambda levels: F.transform(levels, lambda x: F.struct(x["price"].alias("price"), x["quantity"].alias("quantity")))
    made = listed.where(F.size("x") >= 2).select("security", "t", plain(F.reverse(F.slice("x", F.lit(1), half))).alias("bids"), plain(F.slice("x", half + 1, F.size("x") - half)).alias("asks"))
    mode = F.when(F.col("t") % 21_600 == 0, "AUTHENTICATED_READ_ONLY").otherwise("PUBLIC")
    return book.valid_snapshots(made).withColumns({"access_mode": mode, "freshness_status": F.when(F.col("t") % 32_400 == 0, "SERVER_CACHED_LESS_CURRENT").otherwise("LIVE")})


def samples(spark, d):
    """Quote samples: each event is a bid with a spread by user."""
    half = (F.col("user_id") % 7 + 1) / 100.0
    mode = F.when(F.col("series") == "error", "PUBLIC").when(F.col("user_id") % 11 == 0, "PUBLIC").otherwise("AUTHENTICATED_READ_ONLY")
    return src.ticks(spark, d).select("series", "t", "order_key", (F.col("price") - half).alias("bid"), (F.col("price") + half).alias("ask"), mode.alias("mode"))


def book_depth_features(spark, d):
    return rounded(book.depth_features(snapshots(spark, d)).drop("bids", "asks", "access_mode", "freshness_status"))


def snapshot_deltas(spark, d):
    done = book.changes(book.depth_features(snapshots(spark, d)))
    return rounded(done.select("security", "t", "has_previous_snapshot", "seconds_since_previous", "mid_log_return_since_previous", "spread_bps_change", "depth_imbalance_5_change", "microprice_minus_mid_bps_change"))


def book_levels(spark, d):
    """Levels of the rebuilt snapshots: the round trip through the normalised form."""
    again = book.snapshots_of(book.levels_table(snapshots(spark, d)))
    return rounded(book.levels_table(again))


def forward_bars(spark, d):
    done = forward.forward_bars(samples(spark, d), cadence=7200)
    return rounded(done.withColumn("modes", F.array_join(F.transform(F.map_entries("mode_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")).drop("mode_counts"))


def _assessed(spark, d):
    return forward.assessments(samples(spark, d), as_of=1706300000, cadence=7200, horizons={"4h": 14_400, "12h": 43_200, "1d": 86_400})


def forward_gaps(spark, d):
    return rounded(_assessed(spark, d).select("series", "horizon", "bucket", "bucket_end", "status", "snapshot_count", "close"))


def forward_resume(spark, d):
    """Three catch-ups, each from the last assessed end of the one before: as one assessment of all."""
    horizons, done = {"4h": 14_400, "12h": 43_200, "1d": 86_400}, None
    for as_of in (1704800000, 1705200001, 1706300000):
        own = forward.assessments(samples(spark, d), as_of=as_of, cadence=7200, horizons=horizons, assessed=done)
        done = own if done is None else done.unionByName(own)
    reason = forward.gap_reason(F.col("status"), F.col("snapshot_count")).alias("reason")
    return rounded(done.select("series", "horizon", "bucket", "bucket_end", "status", reason, "snapshot_count", "close"))


def admission(spark, d):
    return forward.admission(forward.forward_bars(samples(spark, d), cadence=7200)).select("series", "horizon", "bucket", "admitted", "reason")


def latest_bar_forecast(spark, d):
    return rounded(forward.newest_forecasts(_assessed(spark, d), 0.9))


def horizon_roll_up(spark, d):
    return forward.roll_up(_assessed(spark, d))


MODEL = linear.LinearModel(
    ("log_return_1h", "log_return_24h", "candle_range_pct", "rsi_14h"), (0.0, 0.0, 0.5, 50.0), (1, 3), (0.0, 0.0, 0.6, 50.0, 0.2, 0.1), (1.1, 1.4, 0.8, 20.0, 0.4, 0.3), (-0.4, -0.1, 0.05, 0.02, 0.01, -0.03), 0.001,
)


def _scoring(spark, d):
    frame = rounded(features.base_features(bars_of(spark, d)).select("series", "t", *MODEL.features))
    return frame.join(targets.next_bar(bars_of(spark, d)).select("series", "t", "close", F.col("target_log_return").alias("actual")), ["series", "t"])


def frozen_linear_score(spark, d):
    return rounded(_scoring(spark, d).select("series", "t", MODEL.score().alias("pred")))


def forecast_records(spark, d):
    """Newest bar of each series with baseline and challenger forecasts, prices, directions and clocks."""
    from ..functions.scalars import direction

    newest = forward.latest(_scoring(spark, d), ["series"], 1).withColumn("challenger_return", MODEL.score())
    return rounded(newest.select("series", "t", "close", F.lit(0.0).alias("baseline_return"), "challenger_return", (F.col("close") * F.exp("challenger_return")).alias("challenger_price"), direction(F.round("challenger_return", 9)).alias("challenger_direction"), (F.col("t") + 3600).alias("decision_t"), (F.col("t") + 7200).alias("target_close_t")))


def ridge_gram(spark, d):
    rows = _scoring(spark, d).where("actual IS NOT NULL").na.fill(0.0).withColumn("segment", F.floor(F.col("t") / 864_000).cast("long"))
    return rounded(linear.gram(rows, list(MODEL.features), "actual", ["series", "segment"]))


def ridge_scores(spark, d):
    """A ridge fitted on the first days of all series and applied to the rest."""
    rows = _scoring(spark, d)
    model = linear.fit_ridge(rows.where("t < 1705500000 AND actual IS NOT NULL"), list(MODEL.features), "actual", 10.0)
    return rounded(rows.where("t >= 1705500000").select("series", "t", model.score().alias("pred")))


def imputer_statistics(spark, d):
    return rounded(linear.impute_stats(_scoring(spark, d), list(MODEL.features)))


def spread_scenarios(spark, d):
    rows = _scoring(spark, d).select("series", "t", F.col("close").alias("mid"), F.lit("frozen").alias("model"), F.greatest(F.least(MODEL.score(), F.lit(1.0)), F.lit(-1.0)).alias("pred"))  # a log return beyond 1 is no forecast
    assumed = spark.createDataFrame([("tight", 0.02, 0.01, 5.0, 0.001, 40.0), ("wide", 0.5, 0.05, 5.0, 0.1, 10.0)], "name string, spread double, cost double, wanted double, step double, top double")
    return rounded(spread.spread_scenarios(rows, assumed))


_BOOKS = BARS + """, lv AS (SELECT series AS security, t // 10800 * 10800 AS t, price + 100 AS price, (user_id % 50 + 1)::DOUBLE AS quantity, row_number() OVER (PARTITION BY series, t // 10800 ORDER BY price + 100, user_id % 50 + 1, k) AS i, count(*) OVER (PARTITION BY series, t // 10800) AS n FROM ticks),
sided AS (SELECT security, t, price, quantity, CASE WHEN i <= n // 2 THEN 'bid' ELSE 'ask' END AS side, CASE WHEN i <= n // 2 THEN n // 2 - i + 1 ELSE i - n // 2 END AS level_index FROM lv WHERE n >= 2),
tops AS (SELECT security, t, max(price) FILTER (side = 'bid') AS bp, min(price) FILTER (side = 'ask') AS ap FROM sided GROUP BY ALL),
levels AS (SELECT sided.* FROM sided JOIN tops USING (security, t) WHERE ap > bp)"""


def _agg(side: str) -> str:
    own, five = f"side = '{side}'", f"side = '{side}' AND level_index <= 5"
    return f"""max(price) FILTER ({own} AND level_index = 1) AS {side}_p, max(quantity) FILTER ({own} AND level_index = 1) AS {side}_q, sum(quantity) FILTER ({own} AND level_index <= 3) AS {side}_3, sum(quantity) FILTER ({five}) AS {side}_5,
      sum(price * quantity) FILTER ({five}) AS {side}_pq, sum(abs(price - mid) * quantity) FILTER ({five}) AS {side}_dq, max(price) FILTER ({five}) - min(price) FILTER ({five}) AS {side}_span, count(*) FILTER ({own}) AS {side}_n"""


_DEPTH = f"""{_BOOKS}, mids AS (SELECT security, t, (bp + ap) / 2 AS mid FROM tops), b AS (SELECT security, t, mid, {_agg("bid")}, {_agg("ask")} FROM levels JOIN mids USING (security, t) GROUP BY security, t, mid),
f AS (SELECT *, (ask_p - bid_p) / mid * 10000 AS spread_bps, (bid_5 - ask_5) / (bid_5 + ask_5) AS depth_imbalance_5, (ask_p * bid_q + bid_p * ask_q) / (bid_q + ask_q) AS microprice, ((ask_p * bid_q + bid_p * ask_q) / (bid_q + ask_q) - mid) / mid * 10000 AS bias FROM b)"""
_FEATURES = {
    "mid": "mid", "spread": "ask_p - bid_p", "bid_depth_3": "bid_3", "ask_depth_3": "ask_3", "bid_depth_5": "bid_5", "ask_depth_5": "ask_5", "spread_bps": "spread_bps", "top_bid_quantity": "bid_q", "top_ask_quantity": "ask_q",
    "top_quantity_imbalance": "(bid_q - ask_q) / (bid_q + ask_q)", "log_top_quantity_ratio": "ln(bid_q / ask_q)", "depth_imbalance_3": "(bid_3 - ask_3) / (bid_3 + ask_3)", "depth_imbalance_5": "depth_imbalance_5",
    "microprice": "microprice", "microprice_minus_mid_bps": "bias", "visible_bid_levels": "bid_n", "visible_ask_levels": "ask_n", "authenticated_quote_flag": "(t % 21600 = 0)::INT", "public_cached_quote_flag": "(t % 32400 = 0)::INT",
} | {f"{s}_{n}": x for s in ("bid", "ask") for n, x in (("vwap_5", f"{s}_pq / {s}_5"), ("depth_distance_bps", f"{s}_dq / {s}_5 / mid * 10000"), ("slope_bps", f"CASE WHEN {s}_n < 2 THEN 0 ELSE {s}_span / mid * 10000 / {s}_5 END"))}
_SAMPLES = BARS + """, samples AS (SELECT series, t, k, price - (user_id % 7 + 1) / 100.0 AS bid, price + (user_id % 7 + 1) / 100.0 AS ask, CASE WHEN series = 'error' OR user_id % 11 = 0 THEN 'PUBLIC' ELSE 'AUTHENTICATED_READ_ONLY' END AS mode FROM ticks)"""


def _forward(horizons: dict[str, int], where: str = "true") -> str:
    table = ", ".join(f"('{k}', {v})" for k, v in horizons.items())
    return f"""hz(horizon, seconds) AS (VALUES {table}), e AS (SELECT *, t // seconds * seconds AS bucket, (bid + ask) / 2 AS mid FROM samples, hz WHERE {where}),
fb AS (SELECT series, horizon, seconds, bucket, bucket + seconds AS bucket_end, count(*) AS snapshot_count, ceil(seconds / 7200.0)::BIGINT AS expected, least(1, count(*) / ceil(seconds / 7200.0)) AS coverage, arg_min(mid, (t, k)) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, (t, k)) AS close,
  arg_min(bid, (t, k)) AS open_bid, arg_min(ask, (t, k)) AS open_ask, arg_max(bid, (t, k)) AS close_bid, arg_max(ask, (t, k)) AS close_ask, arg_max(ask - bid, (t, k)) AS close_spread, avg(ask - bid) AS mean_spread, max(ask - bid) AS max_spread, min(t) AS first_t, max(t) AS last_t,
  count(*) FILTER (mode = 'PUBLIC') AS pub, count(*) FILTER (mode <> 'PUBLIC') AS auth FROM e GROUP BY series, horizon, seconds, bucket)"""


_DOUBLES = ("coverage", "open", "high", "low", "close", "open_bid", "open_ask", "close_bid", "close_ask", "close_spread", "mean_spread", "max_spread")
_ASSESSED = f"""{_SAMPLES}, {_forward({"4h": 14400, "12h": 43200, "1d": 86400}, "t < 1706300000")}, fst AS (SELECT series, min(t) AS f0 FROM samples GROUP BY series),
spine AS (SELECT series, horizon, seconds, unnest(range(f0 // seconds * seconds, least((1706300000 - 120) // seconds * seconds, f0 // seconds * seconds + seconds * 512), seconds)) AS bucket FROM fst, hz),
assessed AS (SELECT s.series, s.horizon, s.bucket, s.bucket + s.seconds AS bucket_end, CASE WHEN coalesce(snapshot_count, 0) >= 2 THEN 'BAR_MATERIALIZED' ELSE 'GAP_RECORDED' END AS status, coalesce(snapshot_count, 0) AS snapshot_count, close, coverage FROM spine s LEFT JOIN fb USING (series, horizon, bucket))"""
_SCORING = "base AS (@BASE@), y AS (SELECT series, t, close, CASE WHEN lead(t) OVER w = t + 3600 THEN ln(lead(close) OVER w) - ln(close) END AS actual FROM (@BARS@) WINDOW w AS (PARTITION BY series ORDER BY t)), sc AS (SELECT series, t, close, actual, " + ", ".join(MODEL.features) + " FROM base JOIN y USING (series, t))"
_TERMS = [f"coalesce({f}, {m})" for f, m in zip(MODEL.features, MODEL.medians)] + [f"({MODEL.features[i]} IS NULL)::INT" for i in MODEL.indicators]
_SCORE = f"{MODEL.intercept} + " + " + ".join(f"({x} - {m}) / {s} * {c}" for x, m, s, c in zip(_TERMS, MODEL.means, MODEL.scales, MODEL.coefficients))

_FILLED = ", ".join(f"coalesce({f}, m_{f}) AS {f}, ({f} IS NULL)::INT AS gone_{f}" for f in MODEL.features)
_COLUMNS = [*MODEL.features, *(f"gone_{f}" for f in MODEL.features)]
QUERIES = {f.__name__: f for f in (book_depth_features, snapshot_deltas, book_levels, forward_bars, forward_gaps, forward_resume, admission, latest_bar_forecast, horizon_roll_up, frozen_linear_score, forecast_records, ridge_gram, ridge_scores, imputer_statistics, spread_scenarios)}
ORACLES = {
    "book_depth_features": f"WITH {_DEPTH} SELECT security, t, {rs(_FEATURES)} FROM f",
    "snapshot_deltas": f"""WITH {_DEPTH}, p AS (SELECT *, {", ".join(f"{shift(x, 1, 't', 'security')} AS p_{x}" for x in ("t", "mid", "spread_bps", "depth_imbalance_5", "bias"))} FROM f)
      SELECT security, t, {rs({"has_previous_snapshot": "(p_t IS NOT NULL)::INT", "seconds_since_previous": "coalesce(t - p_t, 0)", "mid_log_return_since_previous": "coalesce(ln(mid / p_mid), 0)", "spread_bps_change": "coalesce(spread_bps - p_spread_bps, 0)", "depth_imbalance_5_change": "coalesce(depth_imbalance_5 - p_depth_imbalance_5, 0)", "microprice_minus_mid_bps_change": "coalesce(bias - p_bias, 0)"})} FROM p""",
    "book_levels": f"WITH {_BOOKS} SELECT security, t, side, level_index::INT AS level_index, {rs({'price': 'price', 'quantity': 'quantity'})} FROM levels",
    "forward_bars": f"""WITH {_SAMPLES}, {_forward(forward.HORIZONS)} SELECT series, horizon, bucket, bucket_end, snapshot_count, expected, {rs({x: x for x in _DOUBLES})}, first_t, last_t,
      CASE WHEN coverage >= 0.9 THEN 'FULL_COVERAGE' WHEN coverage >= 0.5 THEN 'PARTIAL_COVERAGE' ELSE 'SPARSE_COVERAGE' END || CASE WHEN pub = 0 THEN '_AUTHENTICATED' ELSE '_MIXED' END AS quality,
      concat_ws(',', CASE WHEN auth > 0 THEN 'AUTHENTICATED_READ_ONLY=' || auth END, CASE WHEN pub > 0 THEN 'PUBLIC=' || pub END) AS modes FROM fb""",
    "forward_resume": f"""WITH {_ASSESSED} SELECT series, horizon, bucket, bucket_end, status, CASE WHEN status = 'GAP_RECORDED' THEN CASE WHEN snapshot_count = 0 THEN 'NO_OBSERVED_SNAPSHOTS' ELSE 'INSUFFICIENT_OBSERVED_SNAPSHOTS' END END AS reason,
      snapshot_count, {r('close', 'close')} FROM assessed""",
    "forward_gaps": f"WITH {_ASSESSED} SELECT series, horizon, bucket, bucket_end, status, snapshot_count, {r('close', 'close')} FROM assessed",
    "admission": f"""WITH {_SAMPLES}, {_forward(forward.HORIZONS)}, a AS (SELECT *, CASE WHEN snapshot_count < 2 THEN 'INSUFFICIENT_SAMPLES' WHEN snapshot_count > expected THEN 'MORE_SAMPLES_THAN_EXPECTED' WHEN pub > 0 THEN 'UNTRUSTED_MODE' WHEN coverage < 0.9 THEN 'LOW_COVERAGE' ELSE 'ADMITTED' END AS reason FROM fb)
      SELECT series, horizon, bucket, reason = 'ADMITTED' AS admitted, reason FROM a""",
    "latest_bar_forecast": f"""WITH {_ASSESSED}, n AS (SELECT *, CASE WHEN status = 'GAP_RECORDED' THEN 'BLOCKED_BY_GAP' WHEN coverage < 0.9 THEN 'BLOCKED_BY_ADMISSION' ELSE 'FORECAST' END AS forecast_status FROM assessed QUALIFY row_number() OVER (PARTITION BY series, horizon ORDER BY bucket_end DESC) = 1)
      SELECT series, horizon, bucket, bucket_end, {rs({"close": "close", "coverage": "coverage"})}, forecast_status, {rs({"forecast_return": "CASE WHEN forecast_status = 'FORECAST' THEN 0 END", "forecast_price": "CASE WHEN forecast_status = 'FORECAST' THEN close END"})}, CASE WHEN forecast_status = 'FORECAST' THEN 'FLAT' END AS direction FROM n""",
    "horizon_roll_up": f"WITH {_ASSESSED} SELECT horizon, count(*) FILTER (status = 'BAR_MATERIALIZED') AS bars, count(*) FILTER (status = 'GAP_RECORDED') AS gaps, max(bucket_end) AS last_end FROM assessed GROUP BY horizon",
    "frozen_linear_score": f"WITH {_SCORING} SELECT series, t, {r(_SCORE, 'pred')} FROM sc",
    "forecast_records": f"""WITH {_SCORING}, n AS (SELECT *, {_SCORE} AS p FROM sc QUALIFY row_number() OVER (PARTITION BY series ORDER BY t DESC) = 1) SELECT series, t, {rs({"close": "close", "baseline_return": "0", "challenger_return": "p", "challenger_price": "close * exp(p)"})},
      CASE WHEN round(p, 9) > 0 THEN 'UP' WHEN round(p, 9) < 0 THEN 'DOWN' ELSE 'FLAT' END AS challenger_direction, t + 3600 AS decision_t, t + 7200 AS target_close_t FROM n""",
    "ridge_gram": f"""WITH {_SCORING}, z AS (SELECT series, t // 864000 AS segment, actual, {", ".join(f"coalesce({f}, 0) AS {f}" for f in MODEL.features)} FROM sc WHERE actual IS NOT NULL) """
    + " UNION ALL ".join(f"SELECT series, segment, count(*) AS n, '{a}' AS i, '{b}' AS j, {r(f'sum({a} * {1 if b == "1" else b})', 'sum_xy')} FROM z GROUP BY series, segment" for a, b in [(x, "1") for x in (*MODEL.features, "actual")] + [(x, y) for n, x in enumerate((*MODEL.features, "actual")) for y in (*MODEL.features, "actual")[n:]]),
    "ridge_scores": f"""WITH {_SCORING}, tr AS (SELECT 1 AS g, * FROM sc WHERE t < 1705500000 AND actual IS NOT NULL), med AS (SELECT {", ".join(f"coalesce(median({f}), 0) AS m_{f}" for f in MODEL.features)} FROM tr),
      filled AS (SELECT g, actual, {_FILLED} FROM tr, med), te AS (SELECT series, t, {_FILLED} FROM sc, med WHERE t >= 1705500000), {ridge("rg", "filled", "g", _COLUMNS, "actual", 10.0)} SELECT series, t, {r(line("rg", _COLUMNS, "te"), "pred")} FROM te, rg""",
    "imputer_statistics": f"WITH {_SCORING} SELECT {rs({f'median_{f}': f'coalesce(median({f}), 0)' for f in MODEL.features})}, {', '.join(f'count(*) FILTER ({f} IS NULL) AS missing_{f}' for f in MODEL.features)} FROM sc",
    "spread_scenarios": f"""WITH {_SCORING}, a(name, spread, cost, wanted, step, top) AS (VALUES ('tight', 0.02::DOUBLE, 0.01::DOUBLE, 5.0::DOUBLE, 0.001::DOUBLE, 40.0::DOUBLE), ('wide', 0.5, 0.05, 5.0, 0.1, 10.0)), b AS (SELECT series, t, 'frozen' AS model, a.*, close AS mid, close * exp(greatest(least({_SCORE}, 1), -1)) AS later FROM sc, a),
      x AS (SELECT *, 'LONG' AS side, later - spread / 2 - (mid + spread / 2) - cost AS margin FROM b UNION ALL SELECT *, 'SHORT', mid - spread / 2 - (later + spread / 2) - cost FROM b), q AS (SELECT *, CASE WHEN round(margin, 6) > 0 THEN greatest(1, ceil(round(wanted / margin, 9) / step - 1e-12)) * step END AS quantity FROM x)
      SELECT series, t, model, name, side, {rs({"margin": "margin", "quantity": "quantity", "profit": "quantity * margin"})}, coalesce(quantity <= top, false) AS fillable FROM q""",
}




def _fill() -> None:
    from .features import ORACLES as feature_sql

    own = feature_sql["base_features"]
    bars = f"WITH {BARS} SELECT * FROM bars"
    for name, sql in ORACLES.items():
        ORACLES[name] = sql.replace("@BASE@", own).replace("@BARS@", bars)


_fill()
