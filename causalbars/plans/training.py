"""Training datasets: validate, filter, features, labels, final rows, splits, guard, artefacts."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features, splits, targets
from ..operators.bars import require_valid


class LeakageError(ValueError):
    """The dataset could tell a model its future."""


def finalise(frame: DataFrame, names: list[str]) -> DataFrame:
    """Rows with a label and without infinities; missing features stay missing."""
    finite = F.col("target_log_return").isNotNull()
    for n in names:
        finite = finite & F.coalesce(F.abs(F.col(n).cast("double")) != float("inf"), F.lit(True))
    return frame.where(finite)


def guard(frame: DataFrame, names: list[str]) -> None:
    """Raises LeakageError for suspicious names, wrong label clocks, labels across splits or shared times."""
    if len(set(names)) != len(names):
        raise LeakageError("feature names repeat")
    ahead = [n for n in names if n.startswith("target") or "future" in n or "next_" in n]
    if ahead:
        raise LeakageError(f"forward-looking feature names: {ahead}")
    faults = splits.leakage_report(frame.where("split IS NOT NULL")).agg(F.sum("wrong_clock").alias("wrong_clock"), F.sum("late_labels").alias("late_labels"), F.sum("shared_times").alias("shared_times")).first()
    if any(faults[k] for k in ("wrong_clock", "late_labels", "shared_times")):
        raise LeakageError(f"faults: {faults.asDict()}")


@dataclass(frozen=True)
class Dataset:
    rows: DataFrame
    names: list[str]

    def manifest(self) -> dict:
        """Rows and time range of each split, and the ordered feature list."""
        parts = self.rows.groupBy("split").agg(F.count("*").alias("rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).where("split IS NOT NULL").collect()
        return {"features": self.names, "splits": {r["split"]: {"rows": r["rows"], "first_t": r["first_t"], "last_t": r["last_t"]} for r in parts}}

    def write(self, path: str) -> None:
        """Parquet partitioned by split (so readers of train never open test) and a JSON manifest beside it."""
        self.rows.where("split IS NOT NULL").write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([(json.dumps(self.manifest(), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def build(bars: DataFrame, only_ok: bool = False) -> Dataset:
    """The dataset of hourly bars (series, t, OHLC, quality)."""
    require_valid(bars)
    kept = bars.where("quality = 'OK'") if only_ok else bars
    names = features.base_names()
    labels = targets.next_bar(kept).select("series", "t", "close", "target_t", "target_log_return", "target_close")
    frame = finalise(features.base_features(kept).join(labels, ["series", "t"]), names)
    rows = splits.chronological(frame)
    guard(rows, names)
    return Dataset(rows, names)


def read_development(spark, path: str) -> DataFrame:
    """Train and validation rows only: partition pruning keeps the test files closed."""
    return spark.read.parquet(f"{path}/rows").where(F.col("split").isin("train", "validation"))
