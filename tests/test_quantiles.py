"""Distributed quantiles and ranks against Spark's own, which hold a group in one buffer."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from causalbars.operators import linear, quantiles

PROBABILITIES = (0.0, 0.025, 0.25, 0.5, 0.67, 0.975, 1.0)


@pytest.fixture(scope="module")
def table(spark):
    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 7.0
    group = F.when(F.col("id") % 3 == 0, "ties").when(F.col("id") % 3 == 1, "spread").when(F.col("id") % 50 == 2, F.lit(None)).otherwise("one")
    value = F.when(F.col("k") == "ties", F.floor(h / 40)).when(F.col("k") == "one", 5.0).otherwise(F.exp(h / 9) - 3 * h)
    rows = spark.range(9000).select("id", group.alias("k"), h.alias("h"))
    few = spark.createDataFrame([(9001, "pair", 1.0), (9002, "pair", 4.0), (9003, "single", 2.5), (9004, "none", None)], "id long, k string, v double")
    return rows.withColumn("v", value).select("id", "k", F.when(F.col("id") % 101 != 0, F.col("v")).alias("v")).unionByName(few).persist()


@pytest.mark.parametrize("few", [1 << 16, 300])
def test_quantiles_equal_percentile(table, few):
    got = {(r["k"], r["probability"]): r["quantile"] for r in quantiles.quantiles(table, ["k"], "v", PROBABILITIES, few).collect()}
    expected = {}
    for r in table.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, PROBABILITIES))).alias("q")).where("q IS NOT NULL").collect():
        expected |= {(r["k"], p): q for p, q in zip(PROBABILITIES, r["q"])}
    assert got.keys() == expected.keys() and ("none", 0.5) not in got and (None, 0.5) in got
    assert max(abs(got[k] - expected[k]) for k in got) < 1e-9


def test_a_value_with_most_rows(spark):
    rows = spark.range(5000).select(F.lit("a").alias("k"), F.when(F.col("id") < 4000, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert [r["quantile"] for r in quantiles.quantiles(rows, ["k"], "v", [0.1, 0.5], 100).orderBy("probability").collect()] == [7.0, 7.0]
    assert quantiles.quantiles(rows.where("false"), ["k"], "v", [0.5]).count() == 0


def test_ranks_equal_window_ranks(table):
    w, ties = Window.partitionBy("k").orderBy("v"), Window.partitionBy("k", "v")
    expected = {r["id"]: r["x"] for r in table.select("id", (F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0).alias("x")).collect()}
    ranked = quantiles.ranks(table, ["k"], "v", "x")
    assert {r["id"]: r["x"] for r in ranked.collect()} == expected and ranked.columns == [*table.columns, "x"]
    assert quantiles.ranks(table.where("false"), ["k"], "v", "x").count() == 0


def test_no_window_holds_a_group(table):
    """Windows are keyed by group and value range, or run over one row a range."""
    plan = quantiles.ranks(table, ["k"], "v", "x")._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert len(windows) == 2 and sum("_part" in x.split("], [")[1] for x in windows) >= 1


def test_imputer_medians(spark):
    rows = spark.createDataFrame([(float(i % 17), None if i % 3 else float(i), None) for i in range(200)], "a double, b double, c double")
    got = linear.impute_stats(rows, ["a", "b", "c"]).first()
    plain = rows.agg(F.median("a").alias("a"), F.median("b").alias("b")).first()
    assert (got["median_a"], got["median_b"], got["median_c"]) == (plain["a"], plain["b"], 0.0)
    assert (got["missing_a"], got["missing_b"], got["missing_c"]) == (0, 133, 200)
