"""Chronological splits as role columns: no copies, labels never reach across a boundary."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeops import HOUR

CHUNK = 720 * HOUR


def ordinals(frame: DataFrame, by: tuple[str, ...] = ("series",), chunk: int = CHUNK) -> DataFrame:
    """Adds ``n`` (rank from 1 by time in its series) and ``rows`` (of the series).

    Rows are numbered inside chunks of 30 days (or ``chunk`` units of ``t``) and moved on by the counts of earlier chunks, so one long series is
    many tasks.
    """
    keyed = frame.withColumn("_chunk", F.floor(F.col("t") / chunk))
    counts = keyed.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, "_chunk", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("rows"))
    inside = F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy("t"))
    return keyed.withColumn("_inside", inside).join(counts, [*by, "_chunk"]).withColumn("n", F.col("_before") + F.col("_inside")).drop("_chunk", "_inside", "_before")


def dealt(numbered: DataFrame, parts: int, name: str) -> DataFrame:
    """Adds ``name``: the part (from 0) of each row of :func:`ordinals`, dealt by time as evenly as ntile does."""
    extra, size = F.col("rows") % parts, F.floor(F.col("rows") / parts)
    wide = extra * (size + 1)
    part = F.when(F.col("n") <= wide, F.floor((F.col("n") - 1) / (size + 1))).otherwise(extra + F.floor((F.col("n") - 1 - wide) / F.greatest(size, F.lit(1))))
    return numbered.withColumn(name, part.cast("int"))


def boundaries(numbered: DataFrame, named: dict[str, Column]) -> DataFrame:
    """The times of chosen rows of each series: one row a series. Each value is an ordinal column."""
    return numbered.groupBy("series").agg(*[F.min(F.when(F.col("n") == v, F.col("t"))).alias(k) for k, v in named.items()])


def chronological(frame: DataFrame, train: float = 0.70, validation: float = 0.15, purge_hours: int = 1) -> DataFrame:
    """split = train, validation or test of rows (series, t, target_t); NULL for rows whose label would leak.

    Boundaries are the times of the n-th rows; a row must end, label included, ``purge_hours`` before the next part.
    """
    numbered = ordinals(frame)
    first = {"_v": F.floor(F.col("rows") * train) + 1, "_t": F.floor(F.col("rows") * (train + validation)) + 1}
    joined = numbered.join(boundaries(numbered, first), "series")
    purge = purge_hours * HOUR
    ends = F.greatest(F.col("t") + purge, F.coalesce("target_t", F.col("t") + HOUR))
    split = F.when(F.col("t") >= F.col("_t"), "test").when(F.col("t") >= F.col("_v"), F.when(ends < F.col("_t"), "validation")).otherwise(F.when(ends < F.col("_v"), "train"))
    return joined.withColumn("split", split).drop("_v", "_t", "n", "rows")


def walk_forward(frame: DataFrame, folds: int = 4, start: float = 0.5, history_hours: int | None = None) -> DataFrame:
    """(fold, role) of each row: train rows end before the fold's first row; the last fold takes the remainder."""
    numbered = ordinals(frame)
    head = F.floor(F.col("rows") * start)
    size = F.floor((F.col("rows") - head) / folds)
    named = {f"_b{k}": head + size * k + 1 for k in range(folds)}
    bounds = boundaries(numbered, named)
    table = bounds.select("series", F.explode(F.array(*[F.struct(F.lit(k + 1).alias("fold"), F.col(f"_b{k}").alias("from_t"), (F.col(f"_b{k + 1}") if k + 1 < folds else F.lit(None).cast("long")).alias("to_t")) for k in range(folds)])).alias("f")).select("series", "f.*")
    joined = frame.join(table, "series")  # folds rows a series
    test = (F.col("t") >= F.col("from_t")) & (F.col("to_t").isNull() | (F.col("t") < F.col("to_t")))
    train = F.coalesce("target_t", F.col("t") + HOUR) < F.col("from_t")
    if history_hours:
        train = train & (F.col("t") >= F.col("from_t") - history_hours * HOUR)
    return joined.withColumn("role", F.when(test, "validation").when(train, "train")).where("role IS NOT NULL").drop("from_t", "to_t")


def calendar_folds(frame: DataFrame, seconds: int, least_train: int = 1) -> DataFrame:
    """Expanding folds by calendar period: validate on a period, train on labels that end before it; periods with
    fewer than ``least_train`` train rows are left out."""
    period = F.floor(F.col("t") / seconds).cast("long")
    periods = frame.select("series", period.alias("fold")).distinct()
    joined = frame.join(periods, "series").withColumn("from_t", F.col("fold") * seconds)
    role = F.when(period == F.col("fold"), "validation").when(F.coalesce("target_t", F.col("t") + HOUR) < F.col("from_t"), "train")
    marked = joined.withColumn("role", role).where("role IS NOT NULL").drop("from_t")
    enough = marked.groupBy("series", "fold").agg(F.sum((F.col("role") == "train").cast("int")).alias("_n")).where(F.col("_n") >= least_train)
    return marked.join(enough.select("series", "fold"), ["series", "fold"], "left_semi")


def locked_tail(frame: DataFrame, folds: int = 4, test_share: float = 0.2, least_test: int = 30) -> DataFrame:
    """(fold, role): a locked test tail of max(least, ceil(share)) rows and expanding folds over the rest, with
    labels purged at every boundary; fold 0 is the test."""
    numbered = ordinals(frame)
    test = F.greatest(F.lit(least_test), F.ceil(F.col("rows") * test_share))
    rest = F.col("rows") - test
    size = F.floor(rest / (folds + 1))
    tail = F.col("n") > rest
    joined = numbered.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds))))
    first = F.when(F.col("fold") == 0, rest + 1).otherwise(rest - size * (folds + 1 - F.col("fold")) + 1)
    last = F.when(F.col("fold") == 0, F.col("rows")).otherwise(rest - size * (folds - F.col("fold")))
    joined = joined.withColumns({"_first": first, "_last": last, "_tail": tail})
    starts = joined.where("n = _first").select("series", "fold", F.col("t").alias("_from"))
    joined = joined.join(starts, ["series", "fold"])
    role = F.when(F.col("n").between(F.col("_first"), F.col("_last")), F.when(F.col("fold") == 0, "test").otherwise("validation")).when((F.col("n") < F.col("_first")) & (F.coalesce("target_t", F.col("t") + HOUR) < F.col("_from")), "train")
    return joined.withColumn("role", role).where("role IS NOT NULL").drop("_first", "_last", "_tail", "_from", "n", "rows")


def combinatorial(frame: DataFrame, groups: int = 6, held: int = 2, embargo: int = 24) -> DataFrame:
    """Combinatorial purged splits: split_id and role (test, purged, embargoed, train) of each row.

    Rows are dealt to ``groups`` by time as evenly as ntile does; each choice of ``held`` groups is a split. Labels
    that overlap a test group are purged, the ``embargo`` rows after one are embargoed. Group intervals are few
    rows a series, so the range conditions are column expressions over one array.
    """
    numbered = ordinals(frame)
    grouped = dealt(numbered, groups, "group")
    ends = grouped.groupBy("series", "group").agg(F.min("t").alias("lo"), F.max(F.coalesce("target_t", F.col("t") + HOUR)).alias("hi"), F.max("n").alias("last"))
    ends = ends.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("group", F.struct("lo", "hi", "last")))).alias("_g"))
    combos = F.array(*[F.struct(F.lit(i).alias("split_id"), F.array(*map(F.lit, c)).alias("tests")) for i, c in enumerate(combinations(range(groups), held))])
    split = grouped.join(ends, "series").withColumn("c", F.explode(combos)).select("*", "c.split_id", "c.tests").drop("c")
    own_end = F.coalesce("target_t", F.col("t") + HOUR)
    overlaps = F.exists("tests", lambda g: (F.col("t") <= F.col("_g")[g]["hi"]) & (own_end >= F.col("_g")[g]["lo"]))
    after = F.exists("tests", lambda g: (F.col("n") > F.col("_g")[g]["last"]) & (F.col("n") <= F.col("_g")[g]["last"] + embargo))
    role = F.when(F.array_contains("tests", F.col("group")), "test").when(overlaps, "purged").when(after, "embargoed").otherwise("train")
    return split.withColumn("role", role).drop("_g", "tests", "n", "rows", "group")


def leakage_report(split: DataFrame) -> DataFrame:
    """Faults of split rows (series, t, target_t, split): wrong target clocks, labels beyond a split, shared times."""
    ends = split.groupBy("series").agg(*[F.min(F.when(F.col("split") == s, F.col("t"))).alias(f"_{s}") for s in ("validation", "test")])
    late = ((F.col("split") == "train") & (F.col("target_t") >= F.col("_validation"))) | ((F.col("split") == "validation") & (F.col("target_t") >= F.col("_test")))
    per = split.join(ends, "series").groupBy("series").agg(
        F.count("*").alias("rows"), F.sum(F.coalesce(F.col("target_t") != F.col("t") + HOUR, F.lit(False)).cast("int")).alias("wrong_clock"),
        F.sum(F.coalesce(late, F.lit(False)).cast("int")).alias("late_labels"), (F.count("*") - F.count_distinct("t")).alias("shared_times"),
    )
    return per


def coverage(frame: DataFrame, flag: Column, least_share: float, least_rows: int) -> DataFrame:
    """Coverage of each (series, fold, role) and the list of failed rules."""
    per = frame.groupBy("series", "fold", "role").agg(F.avg(flag.cast("double")).alias("share"), F.sum(flag.cast("int")).alias("present"))
    failures = F.array_compact(F.array(F.when(F.col("share") < least_share, F.lit("LOW_SHARE")), F.when(F.col("present") < least_rows, F.lit("FEW_ROWS"))))
    return per.withColumn("failures", F.array_join(failures, ","))
