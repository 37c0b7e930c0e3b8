"""Compare a Spark result with DuckDB: columns, types and every value."""

from __future__ import annotations

import duckdb

from parcelyard.trial.tables import SOURCES

_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(v)) for v in row)


def difference(df, con, sql: str) -> str:
    """Empty when both results hold the same rows."""
    result = con.execute(sql)
    theirs = [(d[0], str(d[1])) for d in result.description]
    rows = result.fetchall()
    ours = [(name, _TYPES.get(kind, kind)) for name, kind in df.dtypes]
    if sorted(ours) != sorted(theirs):
        return f"columns differ: {sorted(set(ours) ^ set(theirs))}"
    names = sorted(df.columns)
    place = [[d[0] for d in theirs].index(n) for n in names]
    expected = sorted((tuple(r[p] for p in place) for r in rows), key=_key)
    actual = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    if len(expected) != len(actual):
        return f"{len(actual)} rows, expected {len(expected)}"
    for a, e in zip(actual, expected):
        if a != e:
            return f"first difference: {dict(zip(names, a))} expected {dict(zip(names, e))}"
    return ""
