"""Compare queries with their SQL in DuckDB: rows as sorted tuples of plain values."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 9)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def compare(spark, con, name, function, sql, folder: str = DATA) -> str:
    """Empty if equal, else what differs."""
    df = function(spark, folder)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    b = rows([c[0] for c in found.description], found.fetchall())
    if a[0] != b[0]:
        return f"{name}: columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{name}: {len(a[1])} and {len(b[1])} rows"
    bad = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    return f"{name}: {len(bad)} of {len(a[1])} rows differ, as {bad[0]}" if bad else ""
