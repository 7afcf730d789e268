"""Run a registered query and its SQL, and compare the results as sets of rows."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb
import pandas as pd


def duckdb_over(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    # As text, so that a negative zero is not taken for zero.
    return repr(value) if isinstance(value, float) else value


def rows(table) -> list[tuple]:
    """Rows of an Arrow table with columns by name, in a fixed order."""
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    cells = [tuple(_cell(v) for v in row) for row in zip(*columns)]
    return sorted(cells, key=lambda r: tuple((v is None, str(type(v)), v or 0) if v is not None
                                             else (True, "", 0) for v in r))


def compare(spark, con, query, sql: str, sf_dir: str) -> dict:
    begin = time.time()
    mine = query(spark, sf_dir).toArrow()
    spark_seconds = time.time() - begin
    begin = time.time()
    other = con.sql(sql).to_arrow_table()
    sql_seconds = time.time() - begin
    types = lambda t: {n: str(t.schema.field(n).type) for n in sorted(t.column_names)}
    same_types = {n: a.replace("large_", "") for n, a in types(mine).items()} == {
        n: a.replace("large_", "") for n, a in types(other).items()
    }
    left, right = rows(mine), rows(other)
    differing = [(a, b) for a, b in zip(left, right) if a != b][:3]
    return {
        "rows": (len(left), len(right)),
        "types": same_types or (types(mine), types(other)),
        "equal": left == right,
        "differing": differing,
        "seconds": (round(spark_seconds, 2), round(sql_seconds, 2)),
    }
