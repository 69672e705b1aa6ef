"""Every query of the library with SQL agrees with DuckDB."""

import pytest
from conftest import SF
from oracle import compare

from causalbars import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_duckdb(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF)


def test_entry_points_import():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
