"""Properties that SQL comparison does not show: causality, halos, faults, streams, models."""

import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from causalbars.functions import clocks, scalars, timeops
from causalbars.operators import bars, features, ledger, linear, resampling, splits, states, targets
from causalbars.plans import training, walk_forward
from causalbars.sources import payloads, tables
from causalbars.streaming import jobs

HOUR = 3600


@pytest.fixture(scope="module")
def hourly(spark):
    rows = []
    for s, phase in (("a", 0.0), ("b", 1.0)):
        for i in range(1500):
            if i % 97 == 5:
                continue
            close = 100 + i * 0.01 + 3 * math.sin(i / 9 + phase)
            rows.append((s, 1_700_000_000 // HOUR * HOUR + i * HOUR, close - 0.2, close + 0.5, close - 0.5, close, "OK" if i % 50 else "PARTIAL_SOURCE_HOUR"))
    return spark.createDataFrame(rows, "series string, t long, open double, high double, low double, close double, quality string").persist()


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_features_do_not_see_the_future(hourly):
    cut = hourly.agg(F.percentile_approx("t", 0.6)).first()[0]
    changed = hourly.withColumns({c: F.when(F.col("t") > cut, F.col(c) * 100).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    one = as_dict(features.base_features(hourly).where(F.col("t") <= cut), "series", "t")
    two = as_dict(features.base_features(changed).where(F.col("t") <= cut), "series", "t")
    assert one == two and len(one) > 1000


def test_chunks_with_halo_equal_whole_series(hourly):
    small = as_dict(features.base_features(hourly, chunk_hours=200), "series", "t")
    large = as_dict(features.base_features(hourly, chunk_hours=10**6), "series", "t")
    assert small.keys() == large.keys()
    for key, row in small.items():
        for name, x in row.items():
            y = large[key][name]
            assert x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (key, name, x, y)


def test_missing_hour_is_not_filled(hourly):
    lagged = hourly.select("series", "t", timeops.exact_lag(F.col("close"), 1).alias("p"))
    gaps = lagged.where("p IS NULL").groupBy("series").count().collect()
    assert all(r["count"] >= 15 for r in gaps)


def test_base_names_are_52():
    assert len(features.base_names()) == 52 == len(set(features.base_names()))


def test_dataset_build_and_pruned_read(spark, hourly, tmp_path):
    data = training.build(hourly)
    assert set(data.manifest()["splits"]) == {"train", "validation", "test"}
    data.write(str(tmp_path / "set"))
    plan = training.read_development(spark, str(tmp_path / "set"))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and {r[0] for r in training.read_development(spark, str(tmp_path / "set")).select("split").distinct().collect()} == {"train", "validation"}


def test_guard_finds_leaks(hourly):
    data = training.build(hourly)
    with pytest.raises(training.LeakageError):
        training.guard(data.rows, [*data.names, "target_close"])
    with pytest.raises(training.LeakageError):
        training.guard(data.rows.withColumn("target_t", F.col("t") + 7200), data.names)


def test_invalid_bars_raise(hourly):
    with pytest.raises(ValueError):
        bars.require_valid(hourly.withColumn("high", F.col("low") - 1))
    with pytest.raises(ValueError):
        bars.require_valid(hourly.limit(0))


def test_asof_ways_agree_and_keep_nulls(spark):
    states_rows = spark.createDataFrame([("x", 10, 1.0), ("x", 20, None), ("x", 30, 3.0)], "series string, available long, v double")
    asked = spark.createDataFrame([("x", t) for t in (5, 10, 15, 20, 25, 30, 99)], "series string, t long")
    one = states.asof_by_key(asked, states_rows, "t", "series").select("t", "available", "v")
    two = states.asof_intervals(asked, states_rows.drop("series"), "t").select("t", "available", "v")
    expected = [(5, None, None), (10, 10, 1.0), (15, 10, 1.0), (20, 20, None), (25, 20, None), (30, 30, 3.0), (99, 30, 3.0)]
    assert sorted(map(tuple, one.collect())) == expected == sorted(map(tuple, two.collect()))


def test_publication_clocks_follow_daylight_saving(spark):
    row = spark.sql("SELECT date'2025-01-15' AS w, date'2025-07-15' AS s").select(clocks.close_release(F.col("w")).alias("w"), clocks.close_release(F.col("s")).alias("s")).first()
    assert row["w"] % 86400 == (21 * 60 + 15) * 60 and row["s"] % 86400 == (20 * 60 + 15) * 60
    days = {str(r["day"]): r["next_business"] for r in clocks.calendar(spark, "2024-12-20", "2025-01-05").collect()}
    assert str(days["2024-12-24"]) == "2024-12-26" and str(days["2024-12-31"]) == "2025-01-02"


def test_ledger_chain_continues_and_finds_tampering(spark):
    rows = spark.createDataFrame([("s", i, i * 10) for i in range(6)], "segment string, t long, v long")
    whole = {r["t"]: r["row_hash"] for r in ledger.chain(rows, ["t", "v"]).collect()}
    first = ledger.chain(rows.where("t < 3"), ["t", "v"])
    heads = first.groupBy("segment").agg(F.max_by("row_hash", "t").alias("head"))
    rest = ledger.chain(rows.where("t >= 3"), ["t", "v"], heads=heads)
    again = {r["t"]: r["row_hash"] for r in first.unionByName(rest).collect()}
    assert whole == again
    chained = ledger.chain(rows, ["t", "v"])
    assert ledger.verify(chained, ["t", "v"]).isEmpty()
    assert [r["fault"] for r in ledger.verify(chained.withColumn("v", F.when(F.col("t") == 2, 99).otherwise(F.col("v"))), ["t", "v"]).collect()] == ["CHANGED_ROW"]


def test_ridge_equals_closed_form_and_frozen_scorer(spark, hourly):
    frame = features.base_features(hourly).join(targets.next_bar(hourly).select("series", "t", F.col("target_log_return").alias("y")), ["series", "t"]).where("y IS NOT NULL").withColumn("log_return_6h", F.when(F.col("t") / HOUR % 5 > 0, F.col("log_return_6h")))
    names = ["log_return_1h", "log_return_6h", "candle_range_pct"]
    model = linear.fit_ridge(frame, names, "y", 10.0)
    got = frame.select(*names, "y", model.score().alias("p")).toPandas()
    x = got[names].astype(float)
    filled = x.fillna(x.median())
    wide = np.column_stack([filled, *[x[n].isna().astype(float) for n in names if x[n].isna().any()]])
    z = (wide - wide.mean(0)) / wide.std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(z.shape[1]), z.T @ (got["y"] - got["y"].mean()))
    assert np.allclose(got["p"], z @ w + got["y"].mean(), atol=1e-10)


def test_walk_forward_ridge_beats_nothing_silently(hourly):
    frame = features.base_features(hourly).join(targets.next_bar(hourly).select("series", "t", "close", "target_t", F.col("target_log_return").alias("actual")), ["series", "t"]).where("actual IS NOT NULL")
    done = walk_forward.ridge_walk_forward(frame, {"one": ["log_return_1h"], "two": ["log_return_1h", "log_return_3h"]})
    metrics = walk_forward.compare(done).collect()
    assert len(metrics) == 2 * 2 * 4 and all(m["mae"] < 1 for m in metrics)


def test_splits_are_disjoint_and_purged(hourly):
    rows = targets.next_bar(hourly).where("target_t IS NOT NULL")
    parts = splits.chronological(rows)
    ends = {r["split"]: (r["lo"], r["hi"]) for r in parts.where("series = 'a' AND split IS NOT NULL").groupBy("split").agg(F.min("t").alias("lo"), F.max("target_t").alias("hi")).collect()}
    assert ends["train"][1] < ends["validation"][0] and ends["validation"][1] < ends["test"][0]
    roles = splits.combinatorial(rows)
    assert roles.groupBy("series", "t", "split_id").count().where("count > 1").isEmpty()
    assert roles.select("split_id").distinct().count() == 15


def test_overfitting_is_low_for_a_lasting_winner(spark):
    rng = np.random.default_rng(0)
    rows = [("s", f"m{k}", t, float(rng.normal(0.5 if k == 0 else 0.0, 1))) for k in range(6) for t in range(800)]
    frame = spark.createDataFrame(rows, "series string, model string, t long, ret double")
    assert resampling.overfitting(frame).first()["pbo"] < 0.1
    tests = resampling.zero_mean_tests(frame, 100, 24).collect()
    assert all(r["holm_p"] >= r["p"] for r in tests) and min(tests, key=lambda r: r["p"])["model"] == "m0"
    moments = {"sharpe": 0.2, "n": 500, "skew": 0.0, "kurtosis": 3.0}
    assert resampling.deflated_sharpe(moments, 2, 0.01) > resampling.deflated_sharpe(moments, 200, 0.01)


def test_wilson_bound(spark):
    row = spark.range(1).select(scalars.wilson_lower(F.lit(60), F.lit(100)).alias("x"), scalars.wilson_lower(F.lit(0), F.lit(0)).alias("y")).first()
    assert abs(row["x"] - 0.5020026) < 1e-6 and row["y"] is None


def test_minute_archives(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "X_M1_2025.zip", "w") as archive:
        archive.writestr("STATUS.txt", "ignored")
        archive.writestr("X_M1.csv", "20250102 000000;1;2;0.5;1.5;0\n20250102 000100;1;2;0.5;bad;0\n")
    (tmp_path / "X_M1_2025 (1).zip").write_bytes((tmp_path / "X_M1_2025.zip").read_bytes())
    rows = payloads.semicolon_minutes(payloads.zipped_lines(spark, str(tmp_path / "X_M1_2025.zip"))).orderBy("row_no").collect()
    assert rows[0]["t"] == 1735794000 and rows[1]["close"] is None
    files = payloads.file_catalog(spark, str(tmp_path)).collect()
    assert [f["name"] for f in files] == ["X_M1_2025.zip"] and files[0]["copies"] == 2


def test_payloads(spark):
    json_rows = spark.createDataFrame([('{"candles": [{"t": "1700000000000", "o": "1", "h": "2", "l": "0.5", "c": "1.5"}, {"time": "bad", "open": "x"}]}',)], "value string")
    assert [tuple(r) for r in payloads.candles_from_json(json_rows).collect()] == [(1700000000, 1.0, 2.0, 0.5, 1.5)]
    xml = '<market securityId="AG" currency="USD"><bid price="10" quantity="1"/><bid price="11" quantity="2"/><ask price="12" quantity="1"/><ask price="13" quantity="0"/></market>'
    books = payloads.book_from_xml(spark.createDataFrame([(xml,), ("<!DOCTYPE x><market/>",)], "value string")).collect()
    assert len(books) == 1 and [b["price"] for b in books[0]["bids"]] == [11.0, 10.0] and len(books[0]["asks"]) == 1
    assert payloads.chunk_range(0, 100 * HOUR, 72, spark).count() == 2
    months = payloads.month_plan("2024-11-15", "2025-01-10", "2024-12-01", spark).orderBy("month").collect()
    assert [str(m["month"]) for m in months] == ["2024-12-01", "2025-01-01"] and months[-1]["active"]


def test_stream_equals_batch(spark, tmp_path):
    ticks = tables.table(spark, SF, "events").select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("bid"), (F.col("value") + 1).alias("ask"))
    ticks.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    query = jobs.stream_forward_bars(stream, 14_400).writeStream.outputMode("append").format("memory").queryName("bars").start()
    query.processAllAvailable()
    query.stop()
    made = {(r["series"], r["bucket"]): (r["snapshot_count"], round(r["close"], 9)) for r in spark.sql("SELECT * FROM bars").collect()}
    batch = ticks.withColumn("b", F.floor(F.unix_timestamp("ts") / 14_400) * 14_400).groupBy("series", "b").agg(F.count("*").alias("n"), F.max_by((F.col("bid") + F.col("ask")) / 2, "ts").alias("close")).collect()
    expected = {(r["series"], r["b"]): (r["n"], round(r["close"], 9)) for r in batch}
    assert made and all(expected[k] == v for k, v in made.items())


def test_idempotent_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "series string, t long, close double")
    write = jobs.idempotent_writer(str(tmp_path / "out"), rows.schema, ["series", "t"], ["close"])
    write(rows, 0)
    write(rows, 1)
    write(spark.createDataFrame([("a", 3, 3.0), ("a", 1, 1.0)], rows.schema), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(jobs.RevisionConflict):
        write(spark.createDataFrame([("a", 1, 9.0)], rows.schema), 3)


def test_no_python_in_feature_plans(hourly):
    plan = features.base_features(hourly)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_meta_models_use_earlier_folds_only(hourly):
    from causalbars.plans import meta

    frame = features.base_features(hourly).join(targets.next_bar(hourly).select("series", "t", "close", "target_t", F.col("target_log_return").alias("actual")), ["series", "t"]).where("actual IS NOT NULL")
    done = walk_forward.ridge_walk_forward(frame, {"one": ["log_return_1h"], "two": ["log_return_1h", "log_return_3h"]}).persist()
    stacked = meta.stack(done, ["one", "two"])
    assert {r["fold"] for r in stacked.select("fold").distinct().collect()} == {2, 3, 4}
    changed = done.withColumn("actual", F.when(F.col("fold") == 4, -F.col("actual")).otherwise(F.col("actual")))
    a, b = (as_dict(meta.selective(x).select("series", "model", "fold", "t", "threshold", "kept"), "series", "model", "fold", "t") for x in (done, changed))
    assert a == b and len(a) > 100
    regimes = frame.withColumns({"regime": F.when(F.col("close") > 105, "UP").otherwise("DOWN"), "fold": F.ntile(4).over(timeops._ordered(("series",)))})
    sources = {r["source"] for r in meta.regime_specialists(regimes, ["log_return_1h"], least=100).select("source").distinct().collect()}
    assert "SPECIALIST" in sources


def test_estimators_fit_and_predict(hourly):
    from causalbars.plans import estimators

    frame = features.base_features(hourly).join(targets.next_bar(hourly).select("series", "t", "close", "target_t", F.col("target_log_return").alias("actual")), ["series", "t"]).where("actual IS NOT NULL")
    rows = estimators.walk_forward(frame, ["log_return_1h", "log_return_6h"], ["elastic_net", "boosted_absolute"], folds=1)
    assert {r["model"] for r in rows.select("model").distinct().collect()} == {"elastic_net", "boosted_absolute"} and rows.where("pred IS NULL").isEmpty()


def test_whole_queries_read_all_rows(spark):
    from causalbars import queries
    from causalbars.queries.features import bars_of
    from causalbars.sources import tables

    for suffix in ("", "_whole"):
        run = {n: queries.QUERIES[f"{n}{suffix if n.startswith('ledger') else ''}"](spark, SF) for n in ("ledger_chain", "ledger_verify", "holdout_outcomes", "spread_scenarios")}
        ticks = tables.ticks(spark, SF)
        assert run["ledger_chain"].agg({"n": "sum"}).first()[0] == ticks.count()
        assert run["ledger_verify"].where("fault = 'CHANGED_ROW'").count() == ticks.where("(t * 1000000 + order_key) % 1009 = 0").count()
        close = {(r["series"], r["t"]) for r in bars_of(spark, SF).select("series", "t").collect()}
        assert run["holdout_outcomes"].count() == sum((s, t - 3600) in close and (s, t + 3600) in close for s, t in close)
        assert run["spread_scenarios"].select("series", "t").distinct().count() == len(close)


def test_too_many_assumptions_are_refused(spark):
    from causalbars.operators.spread import spread_scenarios

    forecasts = spark.createDataFrame([("a", 0, 100.0, "m", 0.01)], "series string, t long, mid double, model string, pred double")
    assumed = spark.range(1001).selectExpr("cast(id as string) AS name", "0.1D AS spread", "0.01D AS cost", "5D AS wanted", "0.1D AS step", "10D AS top")
    assert spread_scenarios(forecasts, assumed.limit(1000)).count() == 2000
    with pytest.raises(ValueError):
        spread_scenarios(forecasts, assumed)


def test_no_row_or_conflict_is_lost(spark, tmp_path):
    """Two values of one key in a batch, two snapshots at one time, a state table of many days."""
    from pyspark.sql import types as T

    from causalbars.operators import book, states
    from causalbars.streaming import jobs

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("t", T.LongType()), T.StructField("x", T.DoubleType())])
    write = jobs.idempotent_writer(str(tmp_path / "sink"), schema, ["id", "t"], ["x"])
    write(spark.createDataFrame([("a", 1, 1.0), ("a", 1, 1.0), ("b", 5, 2.0)], schema), 0)
    write(spark.createDataFrame([("a", 1, 1.0), ("c", 9, 3.0)], schema), 1)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 3
    for rows in ([("d", 2, 1.0), ("d", 2, 9.0)], [("b", 5, 2.5)]):
        with pytest.raises(jobs.RevisionConflict):
            write(spark.createDataFrame(rows, schema), 2)

    quotes = spark.createDataFrame([("s", 10, 1.0), ("s", 20, 2.0), ("s", 20, 2.0), ("s", 30, 4.0)], "security string, t long, mid double")
    quotes = quotes.selectExpr("*", "0D AS spread_bps", "0D AS depth_imbalance_5", "0D AS microprice_minus_mid_bps")
    found = sorted((r["t"], r["has_previous_snapshot"], r["seconds_since_previous"]) for r in book.changes(quotes).collect())
    assert found == [(10, 0.0, 0.0), (20, 1.0, 10.0), (20, 1.0, 10.0), (30, 1.0, 10.0)]

    state = [(d * 86_400 + 50, d) for d in (3, 4, 9)] + [(3 * 86_400 + 70, 33)]
    asked = [(t,) for t in (0, 3 * 86_400 + 49, 3 * 86_400 + 50, 3 * 86_400 + 69, 3 * 86_400 + 70, 7 * 86_400, 10 * 86_400)]
    got = states.asof_intervals(spark.createDataFrame(asked, "t long"), spark.createDataFrame(state, "available long, v long"), "t")
    assert [r["v"] for r in got.orderBy("t").collect()] == [None, None, 3, 3, 33, 4, 9]


def test_chunks_equal_whole(spark):
    """Windows give the same values whatever the chunk, for series with gaps."""
    from causalbars.operators import features

    rows = [(s, 3600 * h, 10.0 + (h * 7 + k) % 11, 22.0, 9.0, 10.0 + (h * 5 + k) % 12, "OK") for k, s in enumerate(("a", "b")) for h in range(400) if h % 17 and not 150 < h < 230]
    bars = spark.createDataFrame(rows, "series string, t long, open double, high double, low double, close double, quality string").cache()
    for compute in (features.rsi, features.volatility, features.trend, features.temporal):
        short, whole = compute(bars, chunk_hours=48), compute(bars, chunk_hours=100_000)
        assert short.exceptAll(whole).isEmpty() and whole.count() == short.count() == len(rows)
    side = bars.where("series = 'b'")
    made = [features.relative(bars.where("series = 'a'"), features.auxiliary(side, "x", (1, 24), (24,), chunk_hours=n), "x", (1, 24), (24,), (24,), True, chunk_hours=n) for n in (48, 100_000)]
    assert sorted(map(str, made[0].collect())) == sorted(map(str, made[1].collect()))


def test_chain_of_many_rows_is_plain_hashing(spark):
    import hashlib

    from causalbars.operators import ledger

    rows = spark.range(5000).selectExpr("'s' AS segment", "id AS t", "id * 3 AS cents")
    done = ledger.chain(rows, ["t", "cents"]).orderBy("t").collect()
    link = ledger.GENESIS
    for r in done:
        assert r["previous_row_hash"] == link
        link = hashlib.sha256(f"{link}|cents={r['cents']}|t={r['t']}".encode()).hexdigest()
        assert r["row_hash"] == link
    heads = spark.createDataFrame([("s", link)], "segment string, head string")
    more = ledger.chain(spark.createDataFrame([("s", 9000, 1)], "segment string, t long, cents long"), ["t", "cents"], heads=heads).first()
    assert more["previous_row_hash"] == link
