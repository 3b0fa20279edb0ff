"""Runs a query's SQL in DuckDB over the same tables and compares rows, whatever their order."""

from __future__ import annotations

from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def norm(value: object) -> str:
    """A value for comparison: lists by element, nan as null, -0 as 0."""
    if value is None or value != value:  # noqa: PLR0124
        return "NULL"
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, list):
        return str([norm(v) for v in value])
    return str(value)


def rows_of(sf_dir: str, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    told = con.execute(sql)
    names = [d[0] for d in told.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(norm(r[i]) for i in order) for r in told.fetchall())


def same(frame: DataFrame, sf_dir: str, sql: str) -> None:
    names, want = rows_of(sf_dir, sql)
    assert sorted(frame.columns) == names
    assert sorted(tuple(norm(r[n]) for n in names) for r in frame.collect()) == want
