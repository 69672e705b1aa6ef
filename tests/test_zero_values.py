"""Events of value zero, which the small tables lack, give what the SQL gives."""

from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare

from causalbars import queries


def table(folder, zero):
    """Two hundred and forty hours of three events each; those that ``zero`` names are worth nothing."""
    at = range(720)
    values = {"event_id": at, "ts": [datetime(2024, 1, 1) + timedelta(minutes=20 * i) for i in at], "user_id": [i % 7 for i in at], "event_type": ["view"] * len(at), "value": [0.0 if zero(i) else (37 * i % 101) + 5.25 for i in at]}
    kinds = {"event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(), "event_type": pa.string(), "value": pa.float64()}
    pq.write_table(pa.table(values).cast(pa.schema(kinds)), folder / "events.parquet")
    return folder


@pytest.mark.parametrize("name", ["delta_decode", "delta_payloads", "price_action", "base_features", "family_ablation"])
def test_lows_of_zero_agree_with_duckdb(spark, tmp_path, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name], table(tmp_path, lambda i: i % 150 == 4))


@pytest.mark.parametrize("name", ["delta_decode", "price_action", "base_features"])
def test_opens_and_closes_of_zero_agree_with_duckdb(spark, tmp_path, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name], table(tmp_path, lambda i: i % 101 == 4 or 330 <= i < 333))
