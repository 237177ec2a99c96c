"""Run a registered query in Spark and its SQL in DuckDB and compare rows and columns."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _key(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def spark_rows(frame):
    return sorted(frame.columns), rows_of(frame.columns, frame.collect())


def duck_rows(con, sql: str):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(columns), rows_of(columns, result.fetchall())


# Types of the two engines that hold the same values.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def types_of(frame):
    return {name: TYPES[kind] for name, kind in frame.dtypes}


def duck_types(con, sql: str):
    return {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
