"""Runs a query and its DuckDB SQL over the same tables and compares all rows."""

import math
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    with duckdb.connect() as con:
        for file in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        theirs = rows_of(names, found.fetchall())
    assert sorted(names) == sorted(df.columns)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(ours) == len(theirs)
    assert ours == theirs
