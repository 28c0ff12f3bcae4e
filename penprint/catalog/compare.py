"""Run a registered query and its SQL side by side and compare every value."""

from __future__ import annotations

import glob
import os

import duckdb
from pyspark.sql import DataFrame

_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def differences(df: DataFrame, sql: str, con: duckdb.DuckDBPyConnection) -> list[str]:
    """What differs between a Spark result and a SQL result; empty when they agree."""
    names = sorted(df.columns)
    expected = con.sql(sql)
    if sorted(expected.columns) != names:
        return [f"columns {names} and {sorted(expected.columns)}"]
    here = {c: _TYPES.get(t, t) for c, t in df.dtypes}
    there = dict(zip(expected.columns, map(str, expected.types)))
    problems = [f"type of {c}: {here[c]} and {there[c]}" for c in names if here[c] != there[c]]
    quoted = ", ".join(f'"{c}"' for c in names)
    left = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=_key)
    right = sorted(expected.project(quoted).fetchall(), key=_key)
    if len(left) != len(right):
        problems.append(f"{len(left)} and {len(right)} rows")
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first: {str(wrong[0])[:600]}")
    return problems
