"""Run a query in Spark and its SQL twin in DuckDB and compare the rows as a multiset."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


_KINDS = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "integer": "int32", "bigint": "int64",
    "double": "double", "float": "float", "string": "text", "varchar": "text", "boolean": "bool",
    "timestamp_ntz": "timestamp", "timestamp": "timestamp", "date": "date",
}


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in data)


def compare(df, con, sql: str) -> str:
    """Empty string when equal, else what differs."""
    cur = con.execute(sql)
    theirs_cols = [d[0] for d in cur.description]
    theirs_types = {d[0]: _KINDS.get(str(d[1]).lower(), str(d[1]).lower()) for d in cur.description}
    theirs = cur.fetchall()
    ours_types = {n: _KINDS.get(t, t) for n, t in df.dtypes}
    if sorted(df.columns) != sorted(theirs_cols):
        return f"columns {sorted(df.columns)} != {sorted(theirs_cols)}"
    if ours_types != theirs_types:
        diff = {c: (ours_types[c], theirs_types[c]) for c in ours_types if ours_types[c] != theirs_types[c]}
        return f"types {diff}"
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    other = rows(theirs_cols, theirs)
    if ours == other:
        return ""
    more, less = ours - other, other - ours
    return (
        f"rows {sum(ours.values())} vs {sum(other.values())}; "
        f"only ours {list(more.items())[:3]}; only theirs {list(less.items())[:3]}"
    )
