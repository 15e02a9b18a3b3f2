"""Spark result against DuckDB result: same columns, same rows, in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v if v is None else str(v)


def _multiset(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple("" if v is None else v for v in t))


SPARK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def assert_same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = _multiset(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert {n: SPARK_TYPES[t] for n, t in df.dtypes} == types
    actual = _multiset(df.columns, df.collect())
    assert len(actual) == len(expected)
    for a, e in zip(actual, expected, strict=True):
        assert a == e
    return len(actual)
