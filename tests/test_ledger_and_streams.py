"""Block ledgers, resumed assessments, streams with gaps, and delta payloads."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from causalbars.operators import forward, ledger
from causalbars.sources import payloads
from causalbars.streaming import jobs

COLUMNS = ["t", "v", "note"]


@pytest.fixture(scope="module")
def rows(spark):
    notes = [None, "", "a|b=c", "back\\slash", "plain"]
    made = [(s, i * 7, None if i % 11 == 3 else i / 3, notes[i % 5]) for s in ("hot", "cold") for i in range(300 if s == "hot" else 9)]
    return spark.createDataFrame(made, "segment string, t long, v double, note string").repartition(4).persist()


def plain_text(r):
    def escaped(x):
        return x.replace("\\", "\\\\").replace("|", "\\|").replace("=", "\\=")

    parts = []
    for c in sorted(COLUMNS):
        x = r[c]
        parts.append(c if x is None else f"{c}=" + escaped(repr(x) if isinstance(x, float) else str(x)))
    return "|".join(parts)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_heads(rows, size):
    found = {}
    for s in {r["segment"] for r in rows}:
        own, head = sorted((r for r in rows if r["segment"] == s), key=lambda r: r["t"]), ledger.GENESIS
        for at in range(0, len(own), size):
            link = ledger.GENESIS
            for r in own[at : at + size]:
                link = sha(f"{link}|{plain_text(r)}")
            head = sha(f"{head}|{link}")
            found[s, at // size] = (len(own[at : at + size]), link, head)
    return found


def test_block_heads_are_plain_hashing(rows):
    dealt, heads = ledger.append_blocks(rows, COLUMNS, block_rows=32, chunk=100)
    assert {(r["segment"], r["block"]): (r["rows"], r["digest"], r["head"]) for r in heads.collect()} == plain_heads(rows.collect(), 32)
    assert dealt.groupBy("segment", "block").count().agg(F.max("count")).first()[0] == 32 and dealt.count() == 309
    assert ledger.verify_blocks(dealt, heads, COLUMNS).isEmpty()


def test_blocks_are_appended_and_backdated_rows_refused(spark, rows):
    early, late = rows.where("t < 1000"), rows.where("t >= 1000")
    first, heads = ledger.append_blocks(early, COLUMNS, block_rows=32)
    heads = heads.persist()
    second, more = ledger.append_blocks(late, COLUMNS, heads=heads, block_rows=32)
    whole, all_heads = first.unionByName(second), heads.unionByName(more).persist()
    assert ledger.verify_blocks(whole, all_heads, COLUMNS).isEmpty()
    blocks = [r["block"] for r in all_heads.where("segment = 'hot'").orderBy("block").collect()]
    assert blocks == list(range(len(blocks)))
    other, newcomer = ledger.append_blocks(spark.createDataFrame([("new", 1, 1.0, "x")], rows.schema), COLUMNS, heads=all_heads)
    assert newcomer.first()["block"] == 0
    for t in (5, rows.where("segment = 'hot'").agg(F.max("t")).first()[0]):
        with pytest.raises(ledger.BackdatedRows):
            ledger.append_blocks(spark.createDataFrame([("hot", t, 1.0, "x")], rows.schema), COLUMNS, heads=all_heads)


@pytest.mark.parametrize("change, fault", [
    (lambda d: d.withColumn("v", F.when(F.col("t") == 700, 1.5).otherwise(F.col("v"))), "CHANGED_BLOCK"),
    (lambda d: d.withColumn("note", F.when((F.col("t") == 700) & (F.col("note") == ""), F.lit(None)).otherwise(F.when(F.col("t") == 700, F.lit("")).otherwise(F.col("note")))), "CHANGED_BLOCK"),
    (lambda d: d.where("t <> 700"), "ROW_COUNT"),
    (lambda d: d.where("block <> 3"), "MISSING_BLOCK"),
])
def test_tampering_is_found(rows, change, fault):
    dealt, heads = ledger.append_blocks(rows, COLUMNS, block_rows=32)
    found = ledger.verify_blocks(change(dealt), heads, COLUMNS).collect()
    assert [(r["segment"], r["block"], r["fault"]) for r in found] == [("hot", 3, fault)]


def test_broken_heads_are_found(rows):
    dealt, heads = ledger.append_blocks(rows, COLUMNS, block_rows=32)
    forged = heads.withColumn("head", F.when((F.col("segment") == "hot") & (F.col("block") == 2), F.lit("0" * 64)).otherwise(F.col("head")))
    found = {(r["block"], r["fault"]) for r in ledger.verify_blocks(dealt, forged, COLUMNS).collect()}
    assert found == {(2, "BROKEN_HEAD"), (3, "BROKEN_HEAD")}
    cut = ledger.verify_blocks(dealt, heads.where("NOT (segment = 'hot' AND block = 2)"), COLUMNS).collect()
    assert {(r["block"], r["fault"]) for r in cut} >= {(2, "UNKNOWN_BLOCK"), (3, "BROKEN_HEAD")}


def test_null_and_empty_have_texts_of_their_own(spark):
    frame = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x|b=a", None)], "t long, a string, b string")
    texts = [r[0] for r in frame.orderBy("t").select(ledger.row_text(["a", "b"])).collect()]
    assert texts == ["a|b=a", "a=|b=a", r"a=x\|b\=a|b"]


def samples_of(spark, times):
    return spark.createDataFrame([(s, t, i, 10.0 + t % 7, 10.5 + t % 7, "AUTHENTICATED_READ_ONLY") for i, (s, t) in enumerate(times)], "series string, t long, order_key long, bid double, ask double, mode string")


def test_catch_ups_go_on_and_assessed_buckets_stay(spark):
    times = [("a", t) for t in range(100, 4000, 90) if not 900 <= t < 1500] + [("b", 2500), ("b", 2510)]
    samples, kinds = samples_of(spark, times), {"5m": 300, "10m": 600}
    whole = {tuple(r) for r in forward.assessments(samples, 4000, horizons=kinds).select("series", "horizon", "bucket", "status", "snapshot_count", "close").collect()}
    done = None
    for as_of in (700, 2000, 2000, 4000):
        late = samples if as_of < 4000 else samples.unionByName(samples_of(spark, [("a", 310), ("a", 950), ("a", 951)]))
        own = forward.assessments(late, as_of, horizons=kinds, assessed=done)
        done = own if done is None else done.unionByName(own)
    assert {tuple(r) for r in done.select("series", "horizon", "bucket", "status", "snapshot_count", "close").collect()} == whole
    assert done.count() == len(whole)
    few = forward.assessments(samples, 4000, horizons=kinds, most=3, assessed=done.where("bucket < 600"))
    assert few.where("series = 'a' AND horizon = '5m'").agg(F.min("bucket"), F.max("bucket")).first()[:] == (600, 1200)


def test_stream_assessments_equal_batch_with_gaps_late_rows_and_a_restart(spark, tmp_path):
    batches = [
        [("a", 100), ("a", 190), ("a", 350), ("b", 320)],
        [("a", 1300), ("a", 1310), ("b", 330)],  # a: empty buckets from 600 on
        [("a", 110), ("a", 1320), ("b", 1900), ("b", 1910)],  # 110 is late
        [("c", 2600), ("a", 2700)],
        [("c", 4000)],
    ]
    schema = "series string, ts timestamp, bid double, ask double"
    made = []
    for number, batch in enumerate(batches):
        frame = samples_of(spark, batch).select("series", F.timestamp_seconds("t").alias("ts"), "bid", "ask")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.stream_assessments(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 300, "60 seconds")
        query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).format("parquet").start(str(tmp_path / "out"))  # restarted for each batch
        query.processAllAvailable()
        query.stop()
        made = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {(r["series"], r["bucket"]): (r["status"], r["reason"], r["snapshot_count"], r["close"]) for r in made}
    assert len(got) == len(made)  # nothing is assessed twice
    kept = [x for b in batches for x in b if x != ("a", 110)]
    expected = forward.assessments(samples_of(spark, kept), 3940, delay=0, horizons={"5m": 300})
    reason = forward.gap_reason(F.col("status"), F.col("snapshot_count")).alias("reason")
    plain = {(r["series"], r["bucket"]): (r["status"], r["reason"], r["snapshot_count"], r["close"] if r["status"] == "BAR_MATERIALIZED" else None) for r in expected.select("*", reason).collect()}
    assert got == plain and got["a", 600][1] == "NO_OBSERVED_SNAPSHOTS" and got["b", 2100][0] == "GAP_RECORDED"


def payload(spark, **changed):
    row = {"series": "x", "timestamp": 1_735_689_600_000, "shift": 3_600_000, "multiplier": 0.01, "open": 10.0, "high": 11.0, "low": 9.0, "close": 10.5, "times": [0, 1, 2], "opens": [0, 100, 100], "highs": [0, 100, 100], "lows": [0, 100, 100], "closes": [0, 100, -50]} | changed
    return spark.createDataFrame([tuple(row.values())], "series string, timestamp long, shift long, multiplier double, open double, high double, low double, close double, times array<int>, opens array<int>, highs array<int>, lows array<int>, closes array<int>")


def test_delta_payloads_start_at_their_first_prices(spark):
    bars = payloads.decode_deltas(payload(spark)).orderBy("t").collect()
    start = 1_735_689_600
    assert [r["t"] for r in bars] == [start, start + 3600, start + 3 * 3600]  # the gap stays
    expected = [(10.0, 11.0, 9.0, 10.5), (11.0, 12.0, 10.0, 11.5), (12.0, 13.0, 11.0, 11.0)]
    assert all(math.isclose(a, b) for r, x in zip(bars, expected) for a, b in zip((r["open"], r["high"], r["low"], r["close"]), x))
    assert payloads.decode_deltas(payload(spark, times=[], opens=[], highs=[], lows=[], closes=[])).count() == 0
    assert payloads.decode_deltas(payload(spark).unionByName(payload(spark))).count() == 6


@pytest.mark.parametrize("changed", [{"shift": 60_000}, {"opens": [0, 1]}, {"open": -1.0}, {"high": float("nan")}, {"multiplier": 0.0}, {"timestamp": 1_735_689_601_000}, {"closes": [0, 900, 0]}, {"lows": [0, -2000, 0]}, {"times": [0, -1, 2]}, {"close": None}])
def test_bad_payloads_raise(spark, changed):
    with pytest.raises(Exception, match="bad (payload|bar)"):
        payloads.decode_deltas(payload(spark, **changed)).collect()


def test_payloads_of_events_may_hold_prices_of_zero(spark):
    later, first = payload(spark, lows=[0, -900, 100]), payload(spark, series="y", low=0.0)
    bars = payloads.decode_deltas(later.unionByName(first), zero=True).orderBy("series", "t").collect()
    assert [round(r["low"], 6) for r in bars] == [9.0, 0.0, 1.0, 0.0, 1.0, 2.0]
    for some in (later, first):
        with pytest.raises(Exception, match="bad (payload|bar)"):
            payloads.decode_deltas(some).collect()
    for changed in ({"low": -1.0}, {"lows": [0, -901, 0]}, {"multiplier": 0.0}, {"low": float("nan")}):
        with pytest.raises(Exception, match="bad (payload|bar)"):
            payloads.decode_deltas(payload(spark, **changed), zero=True).collect()
