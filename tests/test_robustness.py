"""Normal distribution columns, deflated Sharpe ratios, gates and stratified bootstrap against plain computations."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalbars.functions import scalars
from causalbars.operators import resampling


def test_normal_columns_equal_the_standard_library(spark):
    x = [-12.0, -8.0, -5.5, -3.2, -1.0, -1e-9, 0.0, 0.3, 1.959963984540054, 4.0, 6.5, 9.5, 40.0, None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(scalars.normal_cdf_of(F.col("x"))).collect()]
    assert all(abs(a - NormalDist().cdf(b)) < 1e-12 for a, b in zip(got, x[:-1])) and got[-1] is None
    p = [1e-9, 1e-6, 0.001, 0.02425, 0.3, 0.5, 0.7, 0.97575, 0.999999]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate([*p, 0.0, 1.0])], "i int, p double").orderBy("i").select(scalars.normal_quantile_of(F.col("p"))).collect()]
    assert all(abs(a - NormalDist().inv_cdf(b)) < (1e-9 if 1e-7 < b else 1e-6) for a, b in zip(got, p)) and got[-2:] == [None, None]  # the function itself is good to 1e-16


def returns(spark, rng, n=240):
    made = [(s, m, i * 3600, float(v)) for s in ("a", "b") for m, drift in (("good", 0.4), ("flat", 0.0), ("bad", -0.2)) for i, v in enumerate(rng.normal(drift, 1, n) + rng.exponential(0.2, n))]
    return made, spark.createDataFrame(made, "series string, model string, t long, ret double").repartition(3)


def test_deflated_sharpe_equals_plain(spark):
    made, frame = returns(spark, np.random.default_rng(4))
    trials = spark.createDataFrame([("a", 5), ("a", 7), ("b", 3)], "series string, counted_trials long")
    got = {(r["series"], r["model"]): r for r in resampling.deflated_sharpes(frame, trials).collect()}
    for s, n_trials in (("a", 12), ("b", 3)):
        own = {m: np.array([v for a, b, _, v in made if (a, b) == (s, m)]) for m in ("good", "flat", "bad")}
        sharpe = {m: x.mean() / x.std(ddof=1) for m, x in own.items()}
        euler = 0.5772156649015329
        best = np.std(list(sharpe.values()), ddof=1) * ((1 - euler) * NormalDist().inv_cdf(1 - 1 / n_trials) + euler * NormalDist().inv_cdf(1 - 1 / (n_trials * math.e)))
        for m, x in own.items():
            c = x - x.mean()
            skew, kurtosis = (c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2
            z = (sharpe[m] - best) * math.sqrt(len(x) - 1) / math.sqrt(1 - skew * sharpe[m] + (kurtosis - 1) / 4 * sharpe[m] ** 2)
            r = got[s, m]
            assert abs(r["benchmark"] - best) < 1e-9 and abs(r["z"] - z) < 1e-8 and abs(r["probability"] - NormalDist().cdf(z)) < 1e-9
    with pytest.raises(Exception, match="fewer counted trials"):
        resampling.deflated_sharpes(frame, trials.where("series = 'b' OR counted_trials = 5").withColumn("counted_trials", F.lit(2).cast("long"))).collect()


def test_gates_name_the_lasting_winner(spark):
    _, frame = returns(spark, np.random.default_rng(7), 600)
    trials = spark.createDataFrame([("a", 12), ("b", 12)], "series string, counted_trials long")
    wins = spark.createDataFrame([(s, m, f) for s in "ab" for m, f in (("good", 2 / 3), ("flat", 0.9), ("bad", 0.1))], "series string, model string, better_fraction double")
    done = resampling.robustness_gates(resampling.deflated_sharpes(frame, trials), resampling.overfitting(frame), resampling.zero_mean_tests(frame, 200, 24), wins).collect()
    assert len(done) == 6 and {(r["series"], r["model"]) for r in done if r["evidence"].startswith("ROBUST")} <= {("a", "good"), ("b", "good")}
    assert all(r["gate_splits"] == (r["model"] != "bad") and (r["gate_holm"] == (r["holm_p"] < 0.05 and r["mean"] > 0)) for r in done)


def test_strata_keep_their_weight(spark):
    """Equal values within a stratum: every draw gives the observed means, whatever the blocks."""
    rows = [("a", y, y * 10_000_000 + i * 3600, float(y), 1.0 if y == 2 else 0.0) for y, n in ((1, 7), (2, 50), (3, 129)) for i in range(n)]
    frame = spark.createDataFrame(rows, "series string, year int, t long, v double, w double")
    stats = {"mean": F.col("v") / F.col("rows"), "share": F.when(F.col("w") > 60, F.col("v") / F.col("w"))}
    draws = resampling.stratified_draws(frame, ["series"], "year", ["v", "w"], 300, 24).collect()
    assert len(draws) == 300 and {(r["rows"], round(r["v"], 6), r["w"]) for r in draws} == {(186, 494.0, 50.0)}
    got = {r["statistic"]: r for r in resampling.stratified_intervals(frame, ["series"], "year", ["v", "w"], stats, 300, 24, threshold=2.0).collect()}
    assert abs(got["mean"]["low"] - 494 / 186) < 1e-9 and got["mean"]["p_above"] == 1.0 and got["share"]["low"] is None


def test_stratified_draws_equal_plain_sums(spark):
    rng = np.random.default_rng(0)
    values = {y: rng.normal(size=n) for y, n in ((1, 5), (2, 40))}
    frame = spark.createDataFrame([("a", y, i * 3600, float(v)) for y, x in values.items() for i, v in enumerate(x)], "series string, year int, t long, v double")
    a, b, c, m = resampling.HASH
    got = {r["resample"]: r["v"] for r in resampling.stratified_draws(frame, ["series"], "year", ["v"], 50, 12).collect()}
    for resample in range(50):
        total = 0.0
        for x in values.values():
            for k in range(-(-len(x) // 12)):
                start = ((((resample * a + k * b + c) % m) * 48271 + resample * 7 + k) % m) % len(x)
                total += sum(x[(start + i) % len(x)] for i in range(min(12, len(x) - 12 * k)))
        assert abs(got[resample] - total) < 1e-9
