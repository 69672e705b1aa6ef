"""Bars: building, quarantine, stitching, deduplication, validation, decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as op
from ..sources import payloads
from ..sources import tables as src
from ._sql import BARS, r, rounded, rs


def bars_h1(spark, d):
    return rounded(src.bars(spark, d))


def bars_quarantine(spark, d):
    return rounded(op.conservative_bars(src.minutes(spark, d), full=3, most=12))


def suspicious_hours(spark, d):
    return op.suspicious_hours(src.minutes(spark, d), most=12).withColumnRenamed("hour", "t")


def aggregation_report(spark, d):
    return op.aggregation_report(src.minutes(spark, d), full=3, most=12)


def bars_stitch(spark, d):
    return rounded(op.stitch(op.fragment_bars(src.minutes(spark, d))))


def dedupe_keep_last(spark, d):
    hits = src.ticks(spark, d).select("series", "user_id", "t", "order_key", "price")
    return rounded(op.keep_last(hits, ["series", "user_id"], ["t", "order_key"]))


def release_bundle(spark, d):
    daily = src.table(spark, d, "orders").groupBy(src.day_of("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("value"))
    observed = F.datediff("day", F.lit("1970-01-01"))
    states = daily.select((F.floor(observed / 7) * 7 + 9).cast("long").alias("available"), observed.cast("long").alias("observed"), "value")
    return rounded(op.release_bundles(states))


def ohlc_validate(spark, d):
    return op.validation_report(src.minutes(spark, d).select("series", "t", *op.OHLC))


def delta_decode(spark, d):
    return rounded(payloads.decode_deltas(payloads.encode_deltas(src.bars(spark, d)), zero=True))


def delta_payloads(spark, d):
    """Payloads whose first prices are three units off the first bar: only a decoder that adds them to the deltas gets
    the bars back."""
    sent = payloads.encode_deltas(src.bars(spark, d))
    off = [(F.col(p) - 3 * F.col("multiplier")).alias(p) for p in payloads.PRICES]
    first = [F.transform(f"{p}s", lambda x, i: F.when(i == 0, x + 3).otherwise(x)).alias(f"{p}s") for p in payloads.PRICES]
    kept = sent.where(" AND ".join(f"{p} > 0.03" for p in payloads.PRICES))
    return rounded(payloads.decode_deltas(kept.select("series", "timestamp", "shift", "multiplier", "times", *off, *first), zero=True))


MINUTES = BARS + """,
minutes AS (SELECT series, user_id % 3 AS archive, k * 2 + CASE WHEN k % 501 = 0 THEN 7 ELSE 0 END AS row_no, t // 60 * 60 AS t,
  price AS open, price + 0.5 AS high, price - least(0.5, price / 2) AS low, price AS close FROM ticks),
valid AS (SELECT *, t // 3600 * 3600 AS hour, low > 0 AND high >= greatest(open, close) AND low <= least(open, close) AND high >= low AS ok FROM minutes),
per_minute AS (SELECT series, hour, t, count(DISTINCT (open, high, low, close)) AS versions, count(*) AS n, bool_and(ok) AS ok FROM valid GROUP BY ALL),
by_hour AS (SELECT series, hour, bool_or(versions > 1) AS conflict, bool_or(NOT ok) AS invalid, sum(n) > 12 AS overfull FROM per_minute GROUP BY ALL),
lagged AS (SELECT series, t, lag(t) OVER (PARTITION BY series, archive ORDER BY row_no) AS before FROM minutes),
turned AS (SELECT DISTINCT series, unnest([t // 3600 * 3600, before // 3600 * 3600]) AS hour FROM lagged WHERE before > t),
flagged AS (SELECT h.series, h.hour, conflict, invalid, overfull, turned.hour IS NOT NULL AS reversal FROM by_hour h LEFT JOIN turned USING (series, hour)),
suspicious AS (SELECT * FROM flagged WHERE conflict OR invalid OR overfull OR reversal),
single AS (SELECT series, hour, t, arg_min((open, high, low, close), (archive, row_no)) AS m FROM valid ANTI JOIN suspicious USING (series, hour) GROUP BY ALL),
clean AS (SELECT series, hour AS t, arg_min(m[1], t) AS open, max(m[2]) AS high, min(m[3]) AS low, arg_max(m[4], t) AS close, count(*) AS minute_count,
  CASE WHEN count(*) >= 3 THEN 'OK' ELSE 'PARTIAL_SOURCE_HOUR' END AS quality FROM single GROUP BY series, hour)"""
_OHLC = rs({x: x for x in op.OHLC})
_STITCH = MINUTES.replace("PARTITION BY series, archive", "PARTITION BY series, archive").split("valid AS")[0] + """
valid AS (SELECT *, t // 3600 * 3600 AS hour, low > 0 AND high >= greatest(open, close) AND low <= least(open, close) AS ok FROM minutes),
per_minute AS (SELECT series, archive, hour, t, count(DISTINCT (open, high, low, close)) AS versions, count(*) AS n, bool_and(ok) AS ok FROM valid GROUP BY ALL),
by_hour AS (SELECT series, archive, hour FROM per_minute GROUP BY ALL HAVING bool_or(versions > 1) OR bool_or(NOT ok) OR sum(n) > 60),
lagged AS (SELECT series, archive, t, lag(t) OVER (PARTITION BY series, archive ORDER BY row_no) AS before FROM minutes),
turned AS (SELECT DISTINCT series, archive, unnest([t // 3600 * 3600, before // 3600 * 3600]) AS hour FROM lagged WHERE before > t),
bad AS (SELECT * FROM by_hour UNION SELECT * FROM turned),
single AS (SELECT series, archive, hour, t, arg_min((open, high, low, close), row_no) AS m FROM valid ANTI JOIN bad USING (series, archive, hour) GROUP BY ALL),
fragments AS (SELECT series, archive, hour AS t, (arg_min(m[1], t), max(m[2]), min(m[3]), arg_max(m[4], t)) AS v FROM single GROUP BY series, archive, hour)"""

QUERIES = {f.__name__: f for f in (bars_h1, bars_quarantine, suspicious_hours, aggregation_report, bars_stitch, dedupe_keep_last, release_bundle, ohlc_validate, delta_decode, delta_payloads)}
ORACLES = {
    "bars_h1": f"WITH {BARS} SELECT series, t, {_OHLC}, n_ticks FROM bars",
    "bars_quarantine": f"WITH {MINUTES} SELECT series, t, {_OHLC}, minute_count, quality FROM clean",
    "suspicious_hours": f"WITH {MINUTES} SELECT series, hour AS t, conflict, invalid, overfull, reversal FROM suspicious",
    "aggregation_report": f"""WITH {MINUTES} SELECT (SELECT count(*) FROM valid) AS raw_rows, (SELECT count(*) FROM by_hour) AS raw_hours, (SELECT count(*) FROM valid WHERE NOT ok) AS invalid_rows,
      count(*) AS suspicious_hours, count(*) FILTER (conflict) AS conflict_hours, count(*) FILTER (overfull) AS overfull_hours, count(*) FILTER (reversal) AS reversal_hours,
      (SELECT count(*) FROM clean) AS bars, (SELECT count(*) FROM clean WHERE quality = 'OK') AS full_bars, (SELECT coalesce(sum(minute_count), 0)::BIGINT FROM clean) AS used_minutes FROM suspicious""",
    "bars_stitch": f"""WITH {_STITCH} SELECT series, t, archive, {rs({x: f"v[{i}]" for i, x in enumerate(op.OHLC, 1)})} FROM
      (SELECT series, t, min(archive) AS archive, arg_min(v, archive) AS v FROM fragments GROUP BY series, t HAVING count(DISTINCT v) = 1)""",
    "dedupe_keep_last": f"WITH {BARS} SELECT series, user_id, max(t) AS t, arg_max(k, (t, k)) AS order_key, {r('arg_max(price, (t, k))', 'price')} FROM ticks GROUP BY series, user_id",
    "release_bundle": f"""WITH s AS (SELECT date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + {src.SHIFT_DAYS} AS observed, avg(o_totalprice) AS value FROM orders GROUP BY 1)
      SELECT observed // 7 * 7 + 9 AS available, max(observed) AS observed, {r("arg_max(value, observed)", "value")}, count(*) AS bundle_size FROM s GROUP BY observed // 7 * 7 + 9""",
    "ohlc_validate": f"""WITH {MINUTES}, per_t AS (SELECT series, t, count(*) AS n, count(*) FILTER (NOT ok) AS bad FROM valid GROUP BY ALL)
      SELECT series, sum(n)::BIGINT AS rows, count(*) FILTER (n > 1) AS duplicate_times, count(*) FILTER (t % 3600 <> 0) AS off_hour_times, sum(bad)::BIGINT AS invalid_rows, min(t) AS first_t, max(t) AS last_t FROM per_t GROUP BY series""",
    "delta_payloads": f"""WITH {BARS},
      u AS (SELECT series, t, t // 86400 AS day, {", ".join(f"round({x} / 0.01)::BIGINT AS {x}" for x in op.OHLC)} FROM bars),
      sent AS (SELECT series, day, min(t) * 1000 AS start_ms, {", ".join(f"(arg_min({x}, t) - 3) * 0.01::DOUBLE AS {x}, list({x} ORDER BY t) AS {x}s" for x in op.OHLC)}, list(t ORDER BY t) AS ts FROM u GROUP BY series, day),
      d AS (SELECT series, day, start_ms, {", ".join(op.OHLC)}, unnest(range(1, len(ts) + 1)) AS i, {", ".join(f"{x}s" for x in op.OHLC)}, ts FROM sent WHERE {" AND ".join(f"{x}s[1] > 3" for x in op.OHLC)}),
      s AS (SELECT series, day, start_ms, i, {", ".join(op.OHLC)}, CASE WHEN i = 1 THEN 0 ELSE (ts[i] - ts[i - 1]) // 3600 END AS dt,
        {", ".join(f"CASE WHEN i = 1 THEN 3 ELSE {x}s[i] - {x}s[i - 1] END AS d_{x}" for x in op.OHLC)} FROM d)
      SELECT series, ((start_ms + 3600000 * sum(dt) OVER w) // 1000)::BIGINT AS t, {rs({x: f"(round({x} / 0.01) + sum(d_{x}) OVER w) * 0.01" for x in op.OHLC})}
      FROM s WINDOW w AS (PARTITION BY series, day ORDER BY i)""",
    "delta_decode": f"WITH {BARS} SELECT series, t, {_OHLC} FROM bars",
}
