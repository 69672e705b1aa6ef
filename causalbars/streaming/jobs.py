"""Streams: tumbling forward bars behind a watermark, changes since the last snapshot, idempotent ingest.

A bucket closes when the watermark, i.e. the event time seen less the close delay, passes its end; the batch twins
in ``operators.forward`` take the wall clock as a parameter instead. Late samples are dropped, so an assessed
bucket never changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ledger


def stream_forward_bars(samples: DataFrame, seconds: int, delay: str = "120 seconds") -> DataFrame:
    """Append-mode bars of a stream (series, ts, bid, ask): one row a bucket once it is closed."""
    mid = (F.col("bid") + F.col("ask")) / 2
    windowed = samples.withColumn("mid", mid).withWatermark("ts", delay).groupBy("series", F.window("ts", f"{seconds} seconds"))
    bars = windowed.agg(F.count("*").alias("snapshot_count"), F.min_by("mid", "ts").alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", "ts").alias("close"), F.avg(F.col("ask") - F.col("bid")).alias("mean_spread"))
    return bars.select("series", F.unix_timestamp("window.start").alias("bucket"), F.unix_timestamp("window.end").alias("bucket_end"), "snapshot_count", "open", "high", "low", "close", "mean_spread")


def stream_assessments(samples: DataFrame, seconds: int, delay: str = "120 seconds", least: int = 2) -> DataFrame:
    """Append-mode assessments of a stream (series, ts, bid, ask): a bar, or an explicit gap for an empty or thin
    bucket, once the watermark has passed its end.

    A series' first bucket is that of its first sample. State is the next bucket and the sums of open ones. Event-time
    timers close buckets of a series that has gone silent while others go on; a sample for an assessed bucket is
    dropped, so an assessment never changes, and a restart from the checkpoint goes on at the last assessed end.
    """
    out = "series string, bucket long, bucket_end long, status string, reason string, snapshot_count long, open double, high double, low double, close double"
    kept = "next_bucket long, buckets array<struct<bucket: long, n: long, first_t: double, open: double, high: double, low: double, last_t: double, close: double>>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        begun, stored = state.get if state.exists else (None, [])
        open_ = {x[0]: list(x[1:]) for x in map(tuple, stored)}
        for frame in frames if not state.hasTimedOut else ():
            for t, mid in sorted(zip(frame["t"], frame["mid"])):
                bucket = int(t // seconds) * seconds
                begun = bucket if begun is None else begun
                if bucket < begun and not state.exists:
                    begun = bucket  # the first batch may come in any order
                if bucket >= begun:
                    b = open_.setdefault(bucket, [0, t, mid, mid, mid, t, mid])
                    b[0] += 1
                    if t < b[1]:
                        b[1], b[2] = t, mid
                    if t >= b[5]:
                        b[5], b[6] = t, mid
                    b[3], b[4] = max(b[3], mid), min(b[4], mid)
        closed, made = state.getCurrentWatermarkMs() // 1000, []
        while begun is not None and begun + seconds <= closed:
            n, _, first, high, low, _, last = open_.pop(begun, [0, None, None, None, None, None, None])
            good = n >= least
            reason = None if good else "INSUFFICIENT_OBSERVED_SNAPSHOTS" if n else "NO_OBSERVED_SNAPSHOTS"
            made.append((key[0], begun, begun + seconds, "BAR_MATERIALIZED" if good else "GAP_RECORDED", reason, n, *((first, high, low, last) if good else (None,) * 4)))
            begun += seconds
        if begun is not None:
            state.update((begun, [(k, *v) for k, v in sorted(open_.items())]))
            state.setTimeoutTimestamp(max((begun + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(made, columns=["series", "bucket", "bucket_end", "status", "reason", "snapshot_count", "open", "high", "low", "close"])

    rows = samples.withWatermark("ts", delay).select("series", "ts", (F.unix_micros("ts") / 1_000_000).alias("t"), ((F.col("bid") + F.col("ask")) / 2).alias("mid"))
    return rows.groupBy("series").applyInPandasWithState(step, out, kept, "append", "EventTimeTimeout")


def stream_changes(snapshots: DataFrame) -> DataFrame:
    """Log change of the mid since the last snapshot (security, t, mid) of the same key; the state is one pair."""
    out = "security string, t long, mid double, has_previous boolean, mid_log_return double"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import numpy as np

        before = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("t")
        made = []
        for t, mid in zip(rows["t"], rows["mid"]):
            has = before is not None and before[0] < t
            made.append((key[0], t, mid, has, float(np.log(mid / before[1])) if has else 0.0))
            if before is None or t > before[0]:
                before = (int(t), float(mid))
        state.update(before)
        yield pd.DataFrame(made, columns=["security", "t", "mid", "has_previous", "mid_log_return"])

    return snapshots.groupBy("security").applyInPandasWithState(step, out, "t long, mid double", "append", "NoTimeout")


class RevisionConflict(ValueError):
    """A stored row was sent again with other values."""


def idempotent_writer(path: str, schema: T.StructType, keys: Sequence[str], numbers: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: new keys are appended, identical rows ignored, changed rows raise RevisionConflict.

    A key that stands in one batch with different values is a conflict too. Where ``t`` is a key, only the stored rows
    of the batch's range of times are read.
    The batch number is a partition, written with overwrite, so a batch that is retried replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path).where(F.col("batch") != number)
        except Exception as error:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            stored = spark.createDataFrame([], schema)
        batch = batch.persist()
        first = batch.dropDuplicates(list(keys))
        if "t" in keys:
            span = batch.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
            stored = stored.where(F.col("t").between(span["low"], span["high"]))
        rows = ledger.classify(first, stored, keys, numbers).persist()
        try:
            if not ledger.classify(batch, first, keys, numbers).where("change = 'conflict'").isEmpty():
                raise RevisionConflict(f"batch {number} holds a key with different values")
            if not rows.where("change = 'conflict'").isEmpty():
                raise RevisionConflict(f"batch {number} revises stored rows")
            rows.where("change = 'new'").drop("change").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")
        finally:
            rows.unpersist()
            batch.unpersist()

    return write
