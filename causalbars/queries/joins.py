"""Joins by exact time, by publication, and against append-only tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clocks
from ..operators import bars as bar_op
from ..operators import evaluation, features, ledger, states, targets
from ..operators.forward import latest
from ..sources import tables as src
from ._sql import BARS, pos, r, rounded, rs, shift
from .features import bars_of, one


def _calendar(spark, days):
    """The calendar from the first to the last of ``days``."""
    ends = days.agg(F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last")).first()
    return clocks.calendar(spark, ends["first"] or "1970-01-01", ends["last"] or "1970-01-01")


def daily_states(spark, d):
    """Daily averages of orders with the instant each could first be known; bundles reduced to their last day."""
    daily = src.table(spark, d, "orders").groupBy(src.day_of("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("value"), F.count("*").alias("orders"))
    known = daily.join(_calendar(spark, daily).select("day", "next_business"), "day")
    dated = known.select(clocks.daily_release(F.col("day"), F.col("next_business")).alias("available"), F.datediff("day", F.lit("1970-01-01")).cast("long").alias("observed"), "value", "orders")
    return bar_op.release_bundles(dated)


def publication_calendar(spark, d):
    days = src.table(spark, d, "orders").select(src.day_of("o_orderdate").alias("day")).distinct()
    known = days.join(_calendar(spark, days), "day")
    day = F.col("day")
    tuesday = F.date_sub(day, F.pmod(F.weekday(day) - 1, F.lit(7)))
    return known.select(F.datediff("day", F.lit("1970-01-01")).alias("day"), "is_business", clocks.daily_release(day, F.col("next_business")).alias("daily_t"), clocks.close_release(day).alias("close_t"), clocks.weekly_release(tuesday).alias("weekly_t"))


def _releases(spark, d):
    """Daily averages of orders whose release days follow the rule, closures and overrides made of the order days."""
    daily = src.table(spark, d, "orders").groupBy(src.day_of("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("value"))
    ends = daily.agg(F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last")).first()
    of_month, midnight = F.dayofmonth("day"), F.unix_date("day") * 86_400
    closures = daily.where(of_month == 9).select("day")
    versions = F.array(F.struct(F.lit(4).alias("by"), F.lit(1).alias("after")), F.struct(F.when(of_month == 19, 6).when(of_month == 26, F.lit(None)).alias("by"), F.lit(2).alias("after")))
    overrides = daily.where(of_month.isin(5, 19, 26)).withColumn("v", F.explode(versions)).where((of_month != 5) | (F.col("v.after") == 1))
    overrides = overrides.select("day", F.date_add("day", F.col("v.by")).alias("release_day"), (midnight + F.col("v.after") * 86_400).alias("effective_t"))
    known = daily.join(clocks.calendar(spark, ends["first"] or "1970-01-01", ends["last"] or "1970-01-01", closures).select("day", "next_business"), "day")
    dated = clocks.overridden(known, F.col("next_business"), overrides, "16:15:00")
    return dated.select("available", F.unix_date("day").cast("long").alias("observed"), "value", F.col("overridden").cast("int").alias("overridden"))


def release_overrides(spark, d):
    """What a decision may know when releases move: an older day that is released late does not hide a newer one."""
    asked = targets.decision_clock(bars_of(spark, d)).select("series", "t", "decision_t")
    newest = Window.orderBy("available").rowsBetween(Window.unboundedPreceding, 0)
    bundles = bar_op.release_bundles(_releases(spark, d))  # one row a release: the newest day of those released together
    running = bundles.groupBy(F.col("available")).agg(F.max("observed").alias("observed"), F.max_by("value", "observed").alias("value"), F.max_by("overridden", "observed").alias("overridden"))
    best = F.max(F.struct("observed", "value", "overridden")).over(newest).alias("b")  # one row a release day
    return rounded(states.asof_intervals(asked, running.select("available", best).select("available", "b.*"), "decision_t").select("series", "t", "decision_t", "available", "observed", "value", "overridden"))


def exact_align_join(spark, d):
    side = one(spark, d, "view").select("series", "t", F.col("close").alias("view_close"), F.col("high").alias("view_high"))
    return rounded(features.align_exact(one(spark, d, "click").select("series", "t", "close"), side))


def asof_published_state(spark, d):
    asked = targets.decision_clock(bars_of(spark, d)).select("series", "t", "decision_t")
    return rounded(states.state_flags(states.asof_intervals(asked, daily_states(spark, d), "decision_t"), "state"))


def asof_by_key(spark, d):
    ticks = src.ticks(spark, d)
    day = F.floor(F.col("t") / 86_400)
    daily = ticks.groupBy("series", day.alias("day")).agg(F.avg(F.when(F.col("order_key") % 3 > 0, F.col("price"))).alias("mean_price"))
    dated = daily.select("series", ((F.col("day") + 1) * 86_400 + 7200).alias("available"), "mean_price")
    return rounded(states.asof_by_key(ticks.select("series", "t", "order_key"), dated, "t", "series"))


def release_changes(spark, d):
    daily = src.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.datediff(src.day_of("o_orderdate"), F.lit("1970-01-01")).alias("observed")).agg(F.avg("o_totalprice").alias("x"), F.max("o_totalprice").alias("y"))
    return rounded(states.rate_features(daily.select("series", "observed", (F.col("x") / 1e3).alias("two"), (F.col("y") / 1e3).alias("ten")), "two", "ten"))


def zscore_release(spark, d):
    orders = src.table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), F.datediff(src.day_of("o_orderdate"), F.lit("1970-01-01")).alias("observed"), "o_totalprice", "o_orderkey")
    daily = orders.groupBy("series", "observed").agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"))
    return rounded(states.index_features(daily))


GROUPS = ("managed_long", "managed_short", "managed_spread", "producer_long", "producer_short", "swap_long", "swap_short", "swap_spread", "other_long", "other_short", "nonreportable_long", "nonreportable_short")


def positioning_features(spark, d):
    week = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01")) / 7)
    sums = [F.sum(F.when(F.col("l_partkey") % len(GROUPS) == i, F.col("l_quantity")).otherwise(0.0)).alias(g) for i, g in enumerate(GROUPS)]
    weekly = src.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("series"), week.alias("observed")).agg(F.sum("l_quantity").alias("open_interest"), *sums)
    return rounded(states.positioning_features(weekly).drop(*GROUPS))


def _stored(spark, d):
    return bars_of(spark, d).select("series", "t", "close", "high").where("t % 7200 = 0 OR t % 10800 = 0")


def _incoming(spark, d):
    revised = F.when(F.col("t") % 14400 == 0, F.col("close") * 1.01).otherwise(F.col("close") * (1 + 1e-14))
    return bars_of(spark, d).select("series", "t", revised.alias("close"), "high")


def idempotent_merge_classify(spark, d):
    return ledger.classify(_incoming(spark, d), _stored(spark, d), ["series", "t"], ["close", "high"]).groupBy("series", "change").agg(F.count("*").alias("n"))


def left_anti_append(spark, d):
    return rounded(ledger.unseen(_incoming(spark, d), _stored(spark, d), ["series", "t"]))


def overlap_revisions(spark, d):
    return ledger.revisions(_stored(spark, d), _incoming(spark, d), ["series", "t"], ["close", "high"])


def _segments(spark, d, seconds=86_400):
    ticks = src.ticks(spark, d)
    return ticks.select(F.concat_ws("|", "series", F.floor(F.col("t") / seconds).cast("string")).alias("segment"), (F.col("t") * 1_000_000 + F.col("order_key")).alias("t"), F.round(F.col("price") * 100).cast("long").alias("cents"))


def _heads(rows):
    return ledger.chain(rows, ["t", "cents"]).groupBy("segment").agg(F.count("*").alias("n"), F.max_by("row_hash", "t").alias("head"))


def ledger_chain(spark, d):
    """All events, chained by series and day."""
    return _heads(_segments(spark, d))


def ledger_chain_whole(spark, d):
    """All events, chained by series and hour so that a hot series is many segments."""
    return _heads(_segments(spark, d, 3600))


def _block_ledger(spark, d):
    rows = _segments(spark, d).select(F.split("segment", r"\|")[0].alias("segment"), "t", "cents")
    return ledger.append_blocks(rows, ["t", "cents"], block_rows=64, chunk=30 * 86_400_000_000)


def ledger_blocks(spark, d):
    """All events by series in blocks of 64 rows: hashed in parallel, chained by digest."""
    return _block_ledger(spark, d)[1]


def ledger_block_faults(spark, d):
    rows, heads = _block_ledger(spark, d)
    return ledger.verify_blocks(rows.withColumn("cents", F.when(F.col("t") % 1009 == 0, F.col("cents") + 1).otherwise(F.col("cents"))), heads, ["t", "cents"])


def _faults(rows):
    chained = ledger.chain(rows, ["t", "cents"])
    return ledger.verify(chained.withColumn("cents", F.when(F.col("t") % 1009 == 0, F.col("cents") + 1).otherwise(F.col("cents"))), ["t", "cents"]).select("segment", "t", "fault")


def ledger_verify(spark, d):
    return _faults(_segments(spark, d))


def ledger_verify_whole(spark, d):
    """As ledger_chain_whole: all events by series and hour."""
    return _faults(_segments(spark, d, 3600))


def holdout_outcomes(spark, d):
    own = features.momentum_columns(lags=(1,))["log_return_1h"]
    predictions = bars_of(spark, d).select("series", "t", own.alias("pred")).where("pred IS NOT NULL")
    return rounded(ledger.outcomes(predictions, bars_of(spark, d)))


def thirty_day_blocks(spark, d):
    rows = targets.next_bar(bars_of(spark, d)).where("target_log_return IS NOT NULL")
    return rounded(ledger.period_means(rows, "target_log_return", 1704067200, days=5))


def decision_status(spark, d):
    done = ledger.decision_status(bars_of(spark, d), as_of=1705600000, holdout_from=1705000000, through=1705593600)
    return done.groupBy("series", "status").agg(F.count("*").alias("n"))


def latest_n(spark, d):
    return rounded(latest(bars_of(spark, d).select("series", "t", "close"), ["series"], 24))


def overlap_is_empty(spark, d):
    """Times that two halves of each series share (none) and times only one market has."""
    own, other = one(spark, d, "click").select("t"), one(spark, d, "view").select("t")
    both, missing = own.intersect(other), own.subtract(other)
    return both.select(F.lit("both").alias("part"), "t").unionByName(missing.select(F.lit("click_only").alias("part"), "t")).groupBy("part").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def missing_report(spark, d):
    """Rows and missing cells of the widest feature table."""
    from ..operators.features import base_features

    frame = base_features(bars_of(spark, d)).select("series", "t", "log_return_168h", "realized_vol_168h", "rsi_14h", "gap_from_previous_hours")
    cells = ["log_return_168h", "realized_vol_168h", "rsi_14h", "gap_from_previous_hours"]
    gaps = sum(F.col(c).isNull().cast("int") for c in cells)
    return frame.groupBy("series").agg(F.count("*").alias("rows"), F.sum(gaps).alias("missing_cells"), F.sum((gaps > 0).cast("int")).alias("rows_with_missing"))


def freshness_status(spark, d):
    newest = src.ticks(spark, d).groupBy("series").agg(F.max_by(F.struct("t", "order_key", "price"), F.struct("t", "order_key")).alias("x")).select("series", "x.*")
    age = F.lit(1706658000) - F.col("t")
    status = F.when(age < -5, "CLOCK_ANOMALY").when(age <= 900, "FRESH").otherwise("STALE")
    return rounded(newest.select("series", "t", "price", age.alias("age_seconds"), status.alias("status")))


def model_comparison(spark, d):
    """Paired comparison of two forecasts on the same rows: improvement, share of wins, correlation of errors."""
    from .evaluation import forecasts

    long = forecasts(spark, d)
    pair = long.where("model = 'zero'").select("series", "t", F.abs(F.col("pred") - F.col("actual")).alias("a")).join(long.where("model = 'drift'").select("series", "t", F.abs(F.col("pred") - F.col("actual")).alias("b")), ["series", "t"])
    return rounded(pair.groupBy("series").agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("improvement"), F.avg((F.col("b") < F.col("a")).cast("double")).alias("win_share"), evaluation.correlation("a", "b").alias("error_corr")))


def _fixed(x: str) -> str:
    return f"((month({x}) = 1 AND day({x}) = 1) OR (month({x}) = 6 AND day({x}) = 19 AND year({x}) >= 2021) OR (month({x}) = 7 AND day({x}) = 4) OR (month({x}) = 11 AND day({x}) = 11) OR (month({x}) = 12 AND day({x}) = 25))"


def _holiday(x: str) -> str:
    week = f"ceil(day({x}) / 7.0)"
    return f"""({_fixed(x)} OR (isodow({x}) = 1 AND ((month({x}) = 1 AND {week} = 3) OR (month({x}) = 2 AND {week} = 3) OR (month({x}) = 5 AND day({x}) >= 25) OR (month({x}) = 9 AND {week} = 1) OR (month({x}) = 10 AND {week} = 2)))
      OR (month({x}) = 11 AND isodow({x}) = 4 AND {week} = 4) OR (isodow({x}) = 5 AND {_fixed(f'({x} + 1)')}) OR (isodow({x}) = 1 AND {_fixed(f'({x} - 1)')}))"""


def _new_york(x: str, seconds: int) -> str:
    """Epoch of a New York wall-clock time: daylight saving from the second Sunday of March to the first of November."""
    spring, autumn = f"make_date(year({x}), 3, 8)", f"make_date(year({x}), 11, 1)"
    summer = f"{x} >= {spring} + (7 - isodow({spring}))::INT % 7 AND {x} < {autumn} + (7 - isodow({autumn}))::INT % 7"
    return f"(date_diff('day', DATE '1970-01-01', {x}) * 86400 + {seconds} + CASE WHEN {summer} THEN 14400 ELSE 18000 END)::BIGINT"


_CALENDAR = f"""days AS (SELECT unnest(range((SELECT min(o_orderdate::DATE + {src.SHIFT_DAYS}) FROM orders)::TIMESTAMP, (SELECT max(o_orderdate::DATE + {src.SHIFT_DAYS}) + 16 FROM orders)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day), cal0 AS (SELECT day, isodow(day) < 6 AND NOT {_holiday("day")} AS is_business FROM days),
cal AS (SELECT day, is_business, min(CASE WHEN is_business THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) AS nxt FROM cal0)"""
_DAY = f"(o_orderdate::DATE + {src.SHIFT_DAYS})"
_STATES = f"""{_CALENDAR}, daily AS (SELECT {_DAY} AS day, avg(o_totalprice) AS value, count(*) AS orders FROM orders GROUP BY 1),
dated AS (SELECT {_new_york("nxt", 58500)} AS available, date_diff('day', DATE '1970-01-01', day) AS observed, value, orders FROM daily JOIN cal USING (day)),
states AS (SELECT available, max(observed) AS observed, arg_max(value, observed) AS value, arg_max(orders, observed) AS orders, count(*) AS bundle_size FROM dated GROUP BY available)"""
_TUE, _FRI = "(day - (isodow(day) - 2 + 7)::INT % 7)", "(tue + 3)"
_LATE = " OR ".join(_holiday(f"(tue + {n})") for n in range(-1, 4))
_RATE = {"two": "two", "ten": "ten", "short": "two", "long": "ten", "curve": "ten - two"}
_SER = {"short": "two", "long": "ten", "curve": "(ten - two)"}
_RATE |= {f"{n}_change_{k}release": f"{x} - {shift(x, k, 'observed')}" for k in (1, 5, 20) for n, x in _SER.items()}
_IDX = {x: x for x in ("open", "high", "low", "close")} | {"daily_range_pct": "(high - low) / nullif(open, 0)", "daily_body_pct": "(close - open) / nullif(open, 0)", "close_location": "coalesce((close - low) / nullif(high - low, 0), 0.5)"}
_IDX |= {f"log_return_{k}release": f"ln(close) - {shift('ln(close)', k, 'observed')}" for k in (1, 5, 20)}
for _w in (5, 20, 60):
    _mean, _std, _lo, _hi = (f"({pos(a, 'close', _w, 'observed')})" for a in ("avg", "stddev_pop", "min", "max"))
    _IDX |= {f"return_vol_{_w}release": pos("stddev_pop", "r1", _w, "observed"), f"close_vs_sma_{_w}release": f"close / nullif({_mean}, 0) - 1", f"zscore_{_w}release": f"(close - {_mean}) / nullif({_std}, 0)", f"range_position_{_w}release": f"coalesce((close - {_lo}) / nullif({_hi} - {_lo}, 0), 0.5)"}
_OI = "nullif(open_interest, 0)"
_POS = {f"{g}_net_oi": f"({g}_long - {g}_short) / {_OI}" for g in ("managed", "producer", "swap", "other", "nonreportable")} | {f"{g}_net_contracts": f"{g}_long - {g}_short" for g in ("managed", "producer", "swap")}
_POS |= {f"{g}_gross_oi": f"({g}_long + {g}_short) / {_OI}" for g in ("managed", "producer", "swap")} | {f"{g}_spread_oi": f"{g}_spread / {_OI}" for g in ("managed", "swap")} | {"divergence": f"(managed_long - managed_short) / {_OI} - (producer_long - producer_short) / {_OI}"}
_LATER = {f"open_interest_change_{k}release_pct": f"open_interest / nullif({shift('open_interest', k, 'observed')}, 0) - 1" for k in (1, 4, 13)}
_LATER |= {f"{n}_change_{k}release": f"{n} - {shift(n, k, 'observed')}" for k in (1, 4, 13) for n in ("managed_net_oi", "producer_net_oi", "swap_net_oi", "divergence")}
_LATER |= {f"{n}_zscore_{w}release": f"({n} - ({pos('avg', n, w, 'observed')})) / nullif(({pos('stddev_pop', n, w, 'observed')}), 0)" for w in (13, 26, 52) for n in ("open_interest", "managed_net_oi", "producer_net_oi", "divergence")}
_WEEKLY = "weekly AS (SELECT l_returnflag AS series, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) // 7 AS observed, sum(l_quantity) AS open_interest, " + ", ".join(f"sum(CASE WHEN l_partkey % {len(GROUPS)} = {i} THEN l_quantity ELSE 0 END) AS {g}" for i, g in enumerate(GROUPS)) + " FROM lineitem GROUP BY 1, 2)"
_MERGE = BARS + """, stored AS (SELECT series, t, close, high FROM bars WHERE t % 7200 = 0 OR t % 10800 = 0),
incoming AS (SELECT series, t, CASE WHEN t % 14400 = 0 THEN close * 1.01::DOUBLE ELSE close * (1 + 1e-14) END AS close, high FROM bars)"""
_CHAIN = BARS + """, seg AS (SELECT series || '|' || (t // 86400) AS segment, t * 1000000 + k AS t, round(price * 100)::BIGINT AS cents FROM ticks),
numbered AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY t) AS n FROM seg)"""

_BLOCKS = BARS + """, placed AS (SELECT segment, t, cents, n // 64 AS block, n % 64 AS i FROM (SELECT series AS segment, t * 1000000 + k AS t, round(price * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY series ORDER BY t * 1000000 + k) - 1 AS n FROM ticks))"""
QUERIES = {f.__name__: f for f in (publication_calendar, exact_align_join, asof_published_state, release_overrides, asof_by_key, release_changes, zscore_release, positioning_features, idempotent_merge_classify, left_anti_append, overlap_revisions, ledger_chain, ledger_chain_whole, ledger_verify, ledger_verify_whole, ledger_blocks, ledger_block_faults, holdout_outcomes, thirty_day_blocks, decision_status, latest_n, overlap_is_empty, missing_report, freshness_status, model_comparison)}
ORACLES = {
    "publication_calendar": f"""WITH {_CALENDAR}, d AS (SELECT DISTINCT {_DAY} AS day FROM orders), x AS (SELECT day, is_business, nxt, {_TUE} AS tue FROM d JOIN cal USING (day))
      SELECT date_diff('day', DATE '1970-01-01', day) AS day, is_business, {_new_york("nxt", 58500)} AS daily_t, {_new_york("day", 58500)} AS close_t,
      CASE WHEN {_LATE} THEN CASE WHEN isodow(tue + 6) < 6 AND NOT {_holiday("(tue + 6)")} THEN {_new_york("(tue + 6)", 55800)} ELSE {_new_york("(tue + 7)", 55800)} END ELSE {_new_york(_FRI, 55800)} END AS weekly_t FROM x""",
    "exact_align_join": f"WITH {BARS} SELECT a.series, a.t, {rs({'close': 'a.close', 'view_close': 'b.close', 'view_high': 'b.high'})} FROM bars a LEFT JOIN (SELECT * FROM bars WHERE series = 'view') b USING (t) WHERE a.series = 'click'",
    "asof_published_state": f"""WITH {BARS}, {_STATES} SELECT series, t, t + 3600 AS decision_t, available, observed, {r("value", "value")}, orders, bundle_size, (available IS NOT NULL)::INT AS state_has_published_state,
      {r("(t + 3600 - available) / 3600.0", "state_publication_age_hours")}, coalesce((t + 3600 - available) / 3600.0 BETWEEN 0 AND 1, false)::INT AS state_new_within_1h FROM bars ASOF LEFT JOIN states ON t + 3600 >= available""",
    "release_overrides": f"""WITH {BARS}, {_CALENDAR.split("cal AS")[0]} shut AS (SELECT DISTINCT {_DAY} AS day FROM orders WHERE day({_DAY}) = 9), cal1 AS (SELECT cal0.day, is_business AND shut.day IS NULL AS is_business FROM cal0 LEFT JOIN shut USING (day)),
      cal AS (SELECT day, min(CASE WHEN is_business THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) AS nxt FROM cal1),
      daily AS (SELECT {_DAY} AS day, avg(o_totalprice) AS value FROM orders GROUP BY 1), moved AS (SELECT *, CASE day(day) WHEN 5 THEN day + 4 WHEN 19 THEN day + 6 END AS other FROM daily JOIN cal USING (day)),
      rel AS (SELECT CASE WHEN other IS NOT NULL THEN {_new_york("other", 58500)} ELSE {_new_york("nxt", 58500)} END AS available, date_diff('day', DATE '1970-01-01', day) AS observed, value, (other IS NOT NULL)::INT AS overridden FROM moved),
      best AS (SELECT a.available, max(b.observed) AS observed, arg_max(b.value, b.observed) AS value, arg_max(b.overridden, b.observed) AS overridden FROM (SELECT DISTINCT available FROM rel) a JOIN rel b ON b.available <= a.available GROUP BY a.available)
      SELECT series, t, t + 3600 AS decision_t, available, observed, {r("value", "value")}, overridden FROM bars ASOF LEFT JOIN best ON t + 3600 >= available""",
    "asof_by_key": f"""WITH {BARS}, s AS (SELECT series, (t // 86400 + 1) * 86400 + 7200 AS available, avg(CASE WHEN k % 3 > 0 THEN price END) AS mean_price FROM ticks GROUP BY series, t // 86400)
      SELECT ticks.series, t, k AS order_key, available, {rs({"mean_price": "mean_price", "age_hours": "(t - available) / 3600.0"})} FROM ticks ASOF LEFT JOIN s ON ticks.series = s.series AND t >= available""",
    "release_changes": f"""WITH s AS (SELECT o_orderpriority AS series, date_diff('day', DATE '1970-01-01', {_DAY}) AS observed, avg(o_totalprice) / 1e3 AS two, max(o_totalprice) / 1e3 AS ten FROM orders GROUP BY 1, 2),
      c AS (SELECT *, {", ".join(f"{x} - {shift(x, 1, 'observed')} AS d_{n}" for n, x in _SER.items())} FROM s) SELECT series, observed, {rs(_RATE)}, {rs({f"{n}_change_vol_{w}release": pos("stddev_pop", f"d_{n}", w, "observed") for w in (5, 20) for n in _SER})} FROM c""",
    "zscore_release": f"""WITH s AS (SELECT o_orderpriority AS series, date_diff('day', DATE '1970-01-01', {_DAY}) AS observed, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2),
      c AS (SELECT *, ln(close) - {shift("ln(close)", 1, "observed")} AS r1 FROM s) SELECT series, observed, {rs(_IDX)} FROM c""",
    "positioning_features": f"WITH {_WEEKLY}, a AS (SELECT series, observed, open_interest, {', '.join(f'{x} AS {n}' for n, x in _POS.items())} FROM weekly) SELECT series, observed, {rs({'open_interest': 'open_interest'} | {n: n for n in _POS} | _LATER)} FROM a",
    "idempotent_merge_classify": f"""WITH {_MERGE}, c AS (SELECT i.series, CASE WHEN s.t IS NULL THEN 'new' WHEN abs(i.close - s.close) <= 1e-9 + 1e-12 * abs(s.close) AND abs(i.high - s.high) <= 1e-9 + 1e-12 * abs(s.high) THEN 'same' ELSE 'conflict' END AS change FROM incoming i LEFT JOIN stored s USING (series, t))
      SELECT series, change, count(*) AS n FROM c GROUP BY ALL""",
    "left_anti_append": f"WITH {_MERGE} SELECT series, t, {rs({'close': 'close', 'high': 'high'})} FROM incoming ANTI JOIN stored USING (series, t)",
    "overlap_revisions": f"""WITH {_MERGE}, j AS (SELECT series, t, s.close AS sc, i.close AS ic, s.high AS sh, i.high AS ih FROM stored s JOIN incoming i USING (series, t))
      SELECT series, t, 'close' AS "column" FROM j WHERE NOT abs(sc - ic) <= 1e-10 + 1e-12 * abs(ic) UNION ALL SELECT series, t, 'high' FROM j WHERE NOT abs(sh - ih) <= 1e-10 + 1e-12 * abs(ih)""",
    "ledger_chain": f"""WITH RECURSIVE {_CHAIN}, chain AS (SELECT segment, n, sha256('{ledger.GENESIS}|cents=' || cents || '|t=' || t) AS h FROM numbered WHERE n = 1
      UNION ALL SELECT x.segment, x.n, sha256(c.h || '|cents=' || x.cents || '|t=' || x.t) FROM chain c JOIN numbered x ON x.segment = c.segment AND x.n = c.n + 1) SELECT segment, max(n) AS n, arg_max(h, n) AS head FROM chain GROUP BY segment""",
    "ledger_blocks": f"""WITH RECURSIVE {_BLOCKS}, chain AS (SELECT segment, block, i, sha256('{ledger.GENESIS}|cents=' || cents || '|t=' || t) AS h FROM placed WHERE i = 0
      UNION ALL SELECT x.segment, x.block, x.i, sha256(c.h || '|cents=' || x.cents || '|t=' || x.t) FROM chain c JOIN placed x ON x.segment = c.segment AND x.block = c.block AND x.i = c.i + 1),
      digests AS (SELECT segment, block, max(i) + 1 AS rows, arg_max(h, i) AS digest FROM chain GROUP BY segment, block), spans AS (SELECT segment, block, min(t) AS first_t, max(t) AS last_t FROM placed GROUP BY segment, block),
      heads AS (SELECT segment, block, sha256('{ledger.GENESIS}|' || digest) AS head FROM digests WHERE block = 0 UNION ALL SELECT x.segment, x.block, sha256(h.head || '|' || x.digest) FROM heads h JOIN digests x ON x.segment = h.segment AND x.block = h.block + 1)
      SELECT segment, block, rows, first_t, last_t, digest, head FROM digests JOIN spans USING (segment, block) JOIN heads USING (segment, block)""",
    "ledger_block_faults": f"WITH {_BLOCKS} SELECT DISTINCT segment, block, 'CHANGED_BLOCK' AS fault FROM placed WHERE t % 1009 = 0",
    "ledger_verify": f"WITH {_CHAIN} SELECT segment, t, 'CHANGED_ROW' AS fault FROM seg WHERE t % 1009 = 0",
    "holdout_outcomes": f"""WITH {BARS}, p AS (SELECT series, t, ln(close) - ln(max(close) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN 3600 PRECEDING AND 3600 PRECEDING)) AS pred FROM bars)
      SELECT p.series, p.t, {rs({"pred": "pred", "close": "a.close", "next_close": "b.close", "actual": "ln(b.close / a.close)"})} FROM p JOIN bars a USING (series, t) JOIN bars b ON b.series = p.series AND b.t = p.t + 3600 WHERE pred IS NOT NULL""",
    "thirty_day_blocks": f"""WITH {BARS}, x AS (SELECT series, (t - 1704067200) // 432000 AS block, CASE WHEN lead(t) OVER w = t + 3600 THEN ln(lead(close) OVER w) - ln(close) END AS y FROM bars WINDOW w AS (PARTITION BY series ORDER BY t)),
      m AS (SELECT series, block, count(*) AS n, avg(y) AS mean FROM x WHERE y IS NOT NULL GROUP BY ALL), sp AS (SELECT series, unnest(range(0, 6)) AS block FROM (SELECT DISTINCT series FROM x WHERE y IS NOT NULL)),
      j AS (SELECT sp.series, sp.block, coalesce(n, 0) AS n, mean FROM sp LEFT JOIN m USING (series, block)) SELECT series, block, n, {r("mean", "mean")}, sum(coalesce(mean > 0, false)::INT) OVER (PARTITION BY series)::BIGINT AS positive_blocks FROM j""",
    "decision_status": f"WITH {BARS} SELECT series, CASE WHEN t < 1705000000 THEN 'OUTSIDE_HOLDOUT' WHEN t <> 1705593600 THEN 'CONTEXT' WHEN 1705600000 >= t + 7200 THEN 'TARGET_MAY_BE_KNOWN' ELSE 'PREDICT' END AS status, count(*) AS n FROM bars GROUP BY ALL",
    "latest_n": f"WITH {BARS} SELECT series, t, {r('close', 'close')} FROM bars QUALIFY row_number() OVER (PARTITION BY series ORDER BY t DESC) <= 24",
    "overlap_is_empty": f"""WITH {BARS}, a AS (SELECT t, t IN (SELECT t FROM bars WHERE series = 'view') AS b FROM bars WHERE series = 'click') SELECT CASE WHEN b THEN 'both' ELSE 'click_only' END AS part, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM a GROUP BY ALL""",
    "missing_report": f"""WITH base AS (@BASE@), m AS (SELECT series, (log_return_168h IS NULL)::INT + (realized_vol_168h IS NULL)::INT + (rsi_14h IS NULL)::INT + (gap_from_previous_hours IS NULL)::INT AS g FROM base)
      SELECT series, count(*) AS rows, sum(g)::BIGINT AS missing_cells, count(*) FILTER (g > 0) AS rows_with_missing FROM m GROUP BY series""",
    "freshness_status": f"""WITH {BARS}, n AS (SELECT series, max(t) AS t, arg_max(price, (t, k)) AS price FROM ticks GROUP BY series) SELECT series, t, {r("price", "price")}, 1706658000 - t AS age_seconds,
      CASE WHEN 1706658000 - t < -5 THEN 'CLOCK_ANOMALY' WHEN 1706658000 - t <= 900 THEN 'FRESH' ELSE 'STALE' END AS status FROM n""",
    "model_comparison": """@PRED@, w AS (SELECT series, t, max(abs(actual)) FILTER (model = 'zero') AS a, max(abs(pred - actual)) FILTER (model = 'drift') AS b FROM preds GROUP BY series, t)
      SELECT series, count(*) AS n, """ + rs({"improvement": "avg(a - b)", "win_share": "avg((b < a)::INT)", "error_corr": "covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)"}) + " FROM w GROUP BY series",
}


def _hourly_segments(sql: str) -> str:
    return sql.replace("(t // 86400) AS segment", "(t // 3600) AS segment")


ORACLES |= {"ledger_chain_whole": _hourly_segments(ORACLES["ledger_chain"]), "ledger_verify_whole": _hourly_segments(ORACLES["ledger_verify"])}


def _fill() -> None:
    from .evaluation import PRED
    from .features import ORACLES as feature_sql

    ORACLES["missing_report"] = ORACLES["missing_report"].replace("@BASE@", feature_sql["base_features"])
    ORACLES["model_comparison"] = ORACLES["model_comparison"].replace("@PRED@", f"WITH {PRED}")


_fill()
