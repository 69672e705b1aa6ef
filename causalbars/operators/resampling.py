"""Block bootstrap by prefix sums, overfitting probability, deflated Sharpe ratio, Holm adjustment.

A resample of blocks needs only the cumulative sums at the blocks' ends, so the work is (resamples x blocks)
look-ups and never (resamples x rows). Starts come from integer arithmetic, which any engine repeats exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf, normal_cdf_of, normal_quantile, normal_quantile_of
from .splits import CHUNK, dealt, ordinals

#: Multipliers and modulus of the start hash (fixed values).
HASH = (1103515245, 40503, 12345, 2147483647)


def start_of(resample: Column, block: Column, starts: Column) -> Column:
    """The pseudo-random start (0-based) of a block among ``starts`` places."""
    a, b, c, m = HASH
    x = F.pmod(resample * a + block * b + c, F.lit(m))
    x = F.pmod(x * 48271 + resample * 7 + block, F.lit(m))
    return F.pmod(x, starts)


def _parts(c: str) -> tuple[str, str, str]:
    return c, f"{c}_up", f"{c}_down"


def _apart(columns: Sequence[str]) -> list[Column]:
    """Each column in three: its finite values (0 for others), and 1 where it is NaN or positive, NaN or negative infinity.
    Running sums of these can be taken off each other, which those of infinities cannot."""
    made = []
    for c in columns:
        x, (name, up, down) = F.col(c).cast("double"), _parts(c)
        rises, falls = F.isnan(x) | (x == float("inf")), F.isnan(x) | (x == float("-inf"))
        made += [F.when(rises | falls, 0.0).otherwise(x).alias(name), F.when(rises, 1).otherwise(0).cast("long").alias(up), F.when(falls, 1).otherwise(0).cast("long").alias(down)]
    return made


def _together(finite: Column, up: Column, down: Column) -> Column:
    """The sum whose three parts (see :func:`_apart`) these are."""
    return F.when((up > 0) & (down > 0), float("nan")).when(up > 0, float("inf")).when(down > 0, float("-inf")).otherwise(finite)


def prefix_sums(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, n, <column> summed over the first n rows by t, in the parts of :func:`_apart`), n from 0; chunk by chunk, then
    moved on."""
    names = [p for c in columns for p in _parts(c)]
    keyed = rows.select(key, "t", *_apart(columns)).withColumn("_chunk", F.floor(F.col("t") / CHUNK))
    per = keyed.groupBy(key, "_chunk").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in names])
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(key, "_chunk", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in ("n", *names)])
    inside = Window.partitionBy(key, "_chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = keyed.select(key, "_chunk", F.count("*").over(inside).alias("_i"), *[F.sum(c).over(inside).alias(f"_r{c}") for c in names]).join(per, [key, "_chunk"])
    summed = run.select(key, (F.col("_n") + F.col("_i")).alias("n"), *[(F.col(f"_{c}") + F.col(f"_r{c}")).alias(c) for c in names])
    zero = rows.select(key).distinct().select(key, F.lit(0).cast("long").alias("n"), *[F.lit(0).cast(summed.schema[c].dataType).alias(c) for c in names])
    return summed.unionByName(zero)


def resample_sums(rows: DataFrame, key: str, columns: Sequence[str], resamples: int, block: int, circular: bool = False) -> DataFrame:
    """Sums of each column over resamples of moving blocks; the last block is cut so that n rows are used. A NaN or an
    infinity shows in the blocks that hold it and in no others."""
    prefix = prefix_sums(rows, key, columns)
    names = [p for c in columns for p in _parts(c)]
    sizes = rows.groupBy(key).agg(F.count("*").alias("rows"))
    grid = sizes.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("rows") / block) - 1)))
    starts = F.col("rows") if circular else F.greatest(F.col("rows") - block + 1, F.lit(1))
    used = F.least(F.lit(block), F.col("rows") - F.col("block") * block)
    grid = grid.select(key, "rows", "resample", start_of(F.col("resample").cast("long"), F.col("block"), starts).alias("s"), used.alias("used")).withColumn("e", F.col("s") + F.col("used"))
    low = prefix.select(key, F.col("n").alias("s"), *[F.col(c).alias(f"_s{c}") for c in names])
    high = prefix.select(key, F.col("n").alias("w"), *[F.col(c).alias(f"_e{c}") for c in names])
    wrapped = F.when(F.col("e") > F.col("rows"), F.col("e") - F.col("rows")).otherwise(F.col("e")) if circular else F.least("e", "rows")
    joined = grid.withColumn("w", wrapped).join(low, [key, "s"]).join(high, [key, "w"])
    totals = prefix.join(sizes, key).where("n = rows").select(key, *[F.col(c).alias(f"_t{c}") for c in names])
    joined = joined.join(totals, key)
    wrap = (F.col("e") > F.col("rows")) if circular else F.lit(False)
    inside = lambda c: F.col(f"_e{c}") - F.col(f"_s{c}") + F.when(wrap, F.col(f"_t{c}")).otherwise(0)
    return joined.groupBy(key, "resample").agg(F.first("rows").alias("rows"), *[F.sum(_together(*map(inside, _parts(c)))).alias(c) for c in columns])


def mean_interval(rows: DataFrame, key: str, column: str, resamples: int, block: int, circular: bool = False) -> DataFrame:
    """Mean of a column, its 95 % bootstrap interval and the share of resamples above zero."""
    draws = resample_sums(rows, key, [column], resamples, block, circular).withColumn("m", F.col(column) / F.col("rows"))
    ends = draws.groupBy(key).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("p_positive"))
    return rows.groupBy(key).agg(F.avg(column).alias("mean")).join(ends, key)


def conditional_interval(rows: DataFrame, key: str, hit: str, chosen: str, resamples: int, block: int) -> DataFrame:
    """Bootstrap interval of sum(hit) / sum(chosen); resamples without chosen rows are left out."""
    draws = resample_sums(rows, key, [hit, chosen], resamples, block).where(F.col(chosen) > 0).withColumn("m", F.col(hit) / F.col(chosen))
    return draws.groupBy(key).agg(F.count("*").alias("resamples"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def stratified_draws(rows: DataFrame, by: Sequence[str], stratum: str, columns: Sequence[str], resamples: int, block: int) -> DataFrame:
    """(by, resample, rows, columns): sums over resamples that keep each stratum's number of rows.

    Blocks are drawn circularly inside a stratum, so none crosses into another; all columns share the draws, and strata
    are added up by resample. Nulls in columns count as zero.
    """
    key = F.to_json(F.struct(*by, F.col(stratum).alias("_stratum"))).alias("key")
    keyed = rows.select(key, *by, "t", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    sums = resample_sums(keyed.select("key", "t", *columns), "key", columns, resamples, block, circular=True)
    names = keyed.select("key", *by).distinct()
    return sums.join(names, "key").groupBy(*by, "resample").agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in columns])


def stratified_intervals(rows: DataFrame, by: Sequence[str], stratum: str, columns: Sequence[str], statistics: dict[str, Column], resamples: int = 5000, block: int = 24, threshold: float = 0.0) -> DataFrame:
    """(by, statistic, observed, low, high, p_above): each statistic is an expression of the summed columns and ``rows``; all
    are taken from the same draws. Draws in which a statistic is NULL are left out of its interval."""
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), x.cast("double").alias("v")) for n, x in statistics.items()]))
    whole = rows.groupBy(*by).agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns]).select(*by, values.alias("x")).select(*by, "x.statistic", F.col("x.v").alias("observed"))
    draws = stratified_draws(rows, by, stratum, columns, resamples, block).select(*by, values.alias("x")).select(*by, "x.*")
    ends = draws.groupBy(*by, "statistic").agg(F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"), F.avg((F.col("v") > threshold).cast("double")).alias("p_above"))  # ``resamples`` values a group
    return whole.join(ends, [*by, "statistic"])


def holm(tests: DataFrame, by: Sequence[str], p: str = "p") -> DataFrame:
    """Holm's step-down adjustment within ``by``: running maximum of (m - rank) * p, at most 1."""
    order = Window.partitionBy(*by).orderBy(p, "model")
    m = F.count("*").over(Window.partitionBy(*by))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("_step", step).withColumn("holm_p", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def zero_mean_tests(rows: DataFrame, resamples: int, block: int) -> DataFrame:
    """One-sided block-bootstrap tests that strategies (series, model, t, ret) have mean zero, Holm-adjusted.

    Returns are centred, so draws follow the null; all strategies share the same starts.
    """
    keyed = rows.withColumn("key", F.concat_ws("|", "series", "model"))
    means = keyed.groupBy("key").agg(F.avg("ret").alias("mean"), F.first("series").alias("series"), F.first("model").alias("model"))
    centred = keyed.join(means.select("key", "mean"), "key").withColumn("x", F.col("ret") - F.col("mean"))
    draws = resample_sums(centred.select("key", "t", "x"), "key", ["x"], resamples, block).join(means, "key")
    raised = draws.groupBy("series", "model", "mean").agg(((1 + F.sum((F.round(F.col("x") / F.col("rows"), 12) >= F.round("mean", 12)).cast("int"))) / (resamples + 1)).alias("p"))
    return holm(raised, ["series"])


def overfitting(rows: DataFrame, blocks: int = 8) -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation of (series, model, t, ret).

    One aggregate gives count, sum and sum of squares of each block; all splits into halves use only these.
    """
    numbered = dealt(ordinals(rows, ("series", "model")), blocks, "block")
    stats = numbered.groupBy("series", "model", "block").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    halves = list(combinations(range(blocks), blocks // 2))
    splits = F.explode(F.array(*[F.struct(F.lit(i).alias("split_id"), F.array(*map(F.lit, h)).alias("inside")) for i, h in enumerate(halves)]))
    halved = stats.withColumn("x", splits).select("series", "model", "x.split_id", F.array_contains("x.inside", F.col("block")).alias("is_in"), "n", "s", "q")
    sums = halved.groupBy("series", "model", "split_id", "is_in").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    variance = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    sharpe = sums.withColumn("sharpe", F.coalesce(F.try_divide(F.col("s") / F.col("n"), F.sqrt(F.greatest(variance, F.lit(0.0)))), F.lit(0.0)))
    both = sharpe.groupBy("series", "split_id", "model").agg(F.max(F.when(F.col("is_in"), F.round("sharpe", 10))).alias("inside"), F.max(F.when(~F.col("is_in"), F.round("sharpe", 10))).alias("outside"))
    per = Window.partitionBy("series", "split_id")
    ties = F.count("*").over(Window.partitionBy("series", "split_id", "outside"))
    ranked = both.withColumns({"rank": F.rank().over(per.orderBy("outside")) + (ties - 1) / 2.0, "m": F.count("*").over(per), "best": F.first("model").over(per.orderBy(F.desc("inside"), "model"))})
    relative = F.col("rank") / (F.col("m") + 1)
    chosen = ranked.where("model = best").withColumn("logit", F.ln(relative / (1 - relative)))
    return chosen.groupBy("series").agg(F.count("*").alias("splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.avg("logit").alias("mean_logit"))


def sharpe_moments(rows: DataFrame) -> DataFrame:
    """Sharpe ratio (ddof 1), skewness and raw kurtosis (population moments) of each strategy."""
    return rows.groupBy("series", "model").agg(F.count("*").alias("n"), F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurtosis"))


def expected_best(std: Column, trials: Column) -> Column:
    """The expected greatest Sharpe ratio of ``trials`` strategies without skill whose ratios spread by ``std``."""
    n = trials.cast("double")
    euler = 0.5772156649015329
    z = (1 - euler) * normal_quantile_of(1 - 1 / n) + euler * normal_quantile_of(1 - 1 / (n * math.e))
    return F.when((n > 1) & (std > 0), std * z).otherwise(0.0)


def deflated_sharpes(rows: DataFrame, trials: DataFrame) -> DataFrame:
    """One row a strategy (series, model, t, ret): its Sharpe ratio against the best that ``trials`` (series,
    counted_trials; one row a recorded stage, added up) would show without skill, and the probability of that ratio.

    Fewer counted trials than strategies of a series raise; so does a strategy whose moments give no positive variance.
    Constant strategies must be left out before.
    """
    moments = sharpe_moments(rows)
    spread = moments.groupBy("series").agg(F.count("*").alias("strategies"), F.avg("sharpe").alias("trial_mean"), F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("trial_std"))
    counted = trials.groupBy("series").agg(F.sum("counted_trials").alias("counted_trials"))
    enough = F.when(F.coalesce(F.col("counted_trials") >= F.col("strategies"), F.lit(False)), F.col("counted_trials")).otherwise(F.raise_error(F.lit("fewer counted trials than strategies")).cast("long"))
    per = spread.join(counted, "series", "left").withColumn("counted_trials", enough)
    per = per.withColumn("benchmark", expected_best(F.col("trial_std"), F.col("counted_trials")))  # once a series
    joined = moments.join(per, "series")
    s = F.col("sharpe")
    inner = 1 - F.col("skew") * s + (F.col("kurtosis") - 1) / 4 * s * s
    root = F.sqrt(F.when(inner > 0, inner).otherwise(F.raise_error(F.lit("moments give no positive variance")).cast("double")))
    z = (s - F.col("benchmark")) * F.sqrt(F.col("n") - 1) / root
    return joined.withColumn("z", z).withColumn("probability", normal_cdf_of(F.col("z")))


def robustness_gates(deflated: DataFrame, pbo: DataFrame, tests: DataFrame, wins: DataFrame, least_wins: float = 2 / 3, most_pbo: float = 0.2, least_probability: float = 0.95, most_p: float = 0.05) -> DataFrame:
    """Four gates of each strategy and whether all hold: better in enough splits (wins: series, model, better_fraction),
    low overfitting of its series, deflated Sharpe probability, and Holm-adjusted positive mean."""
    joined = deflated.select("series", "model", "probability").join(wins, ["series", "model"]).join(pbo.select("series", "pbo"), "series").join(tests.select("series", "model", "mean", "holm_p"), ["series", "model"])
    gates = {
        "gate_splits": F.round("better_fraction", 9) >= round(least_wins, 9), "gate_pbo": F.col("pbo") < most_pbo, "gate_dsr": F.col("probability") >= least_probability, "gate_holm": (F.col("holm_p") < most_p) & (F.round("mean", 12) > 0),
    }
    done = joined.withColumns(gates)
    passed = F.col("gate_splits") & F.col("gate_pbo") & F.col("gate_dsr") & F.col("gate_holm")
    return done.withColumn("evidence", F.when(passed, "ROBUST_AFTER_MULTIPLE_TESTING").otherwise("NOT_PROVEN_AFTER_MULTIPLE_TESTING"))


def deflated_sharpe(moments: dict, trials: int, variance: float) -> float:
    """Probability that a Sharpe ratio beats the best of ``trials`` null ones; for one row on the driver."""
    euler = 0.5772156649015329
    best = variance**0.5 * ((1 - euler) * normal_quantile(1 - 1 / trials) + euler * normal_quantile(1 - 1 / (trials * 2.718281828459045)))
    s, n = moments["sharpe"], moments["n"]
    spread = max(1e-12, 1 - moments["skew"] * s + (moments["kurtosis"] - 1) / 4 * s * s)
    return normal_cdf((s - best) * (n - 1) ** 0.5 / spread**0.5)
