"""Documented release days and closures in place of the rules; role checks of splits."""

import datetime

import pytest
from pyspark.sql import functions as F

from causalbars.functions import clocks


def days(spark, rows, schema):
    return spark.createDataFrame([tuple(datetime.date.fromisoformat(x) if isinstance(x, str) and x[:2] == "20" else x for x in r) for r in rows], schema)


def utc(seconds):
    return datetime.datetime.fromtimestamp(seconds, datetime.UTC).strftime("%Y-%m-%d %H:%M")


def test_overrides_take_the_place_of_the_rule(spark):
    states = days(spark, [("2025-01-07", 1.0), ("2025-01-14", 2.0), ("2025-07-01", 3.0), ("2025-07-08", 4.0)], "day date, value double")
    overrides = days(spark, [("2025-01-07", "2025-01-12", 10), ("2025-01-07", "2025-01-13", 20), ("2025-07-08", "2025-07-15", 10), ("2025-07-08", None, 30), ("2024-01-02", "2024-01-09", 5)], "day date, release_day date, effective_t long")
    got = {r["value"]: (utc(r["available"]), r["overridden"]) for r in clocks.overridden(states, F.date_add("day", 3), overrides, "15:30:00").collect()}
    assert got == {1.0: ("2025-01-13 20:30", True), 2.0: ("2025-01-17 20:30", False), 3.0: ("2025-07-04 19:30", False), 4.0: ("2025-07-11 19:30", False)}
    assert clocks.overridden(states, F.date_add("day", 3), overrides.where("false"), "15:30:00").where("overridden").count() == 0
    early = days(spark, [("2025-01-07", "2025-01-06", 1)], "day date, release_day date, effective_t long")
    with pytest.raises(Exception, match="before its day"):
        clocks.overridden(states, F.date_add("day", 3), early, "15:30:00").collect()


def test_closures_move_the_next_business_day(spark):
    plain = {str(r["day"]): str(r["next_business"]) for r in clocks.calendar(spark, "2025-01-06", "2025-01-10").collect()}
    table = days(spark, [("2025-01-09",), ("2025-01-09",)], "day date")
    shut = {str(r["day"]): (str(r["next_business"]), r["is_business"]) for r in clocks.calendar(spark, "2025-01-06", "2025-01-10", table).collect()}
    assert plain["2025-01-08"] == "2025-01-09" and shut["2025-01-08"] == ("2025-01-10", True) and shut["2025-01-09"] == ("2025-01-10", False) and len(shut) == 5
    assert {k: v for k, (v, _) in shut.items()} == {str(r["day"]): str(r["next_business"]) for r in clocks.calendar(spark, "2025-01-06", "2025-01-10", ("2025-01-09",)).collect()}
