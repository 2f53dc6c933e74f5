"""Holds a Spark query against its DuckDB SQL on the same Parquet tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection in which the tables are views."""
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    """A value that compares alike whichever engine it is from."""
    if isinstance(x, bool) or x is None:
        return repr(x)
    if isinstance(x, decimal.Decimal | int | float):
        return "nan" if isinstance(x, float) and math.isnan(x) else repr(float(x) + 0.0)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def differences(spark, con, fn, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    at = [theirs_names.index(n) for n in names]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    if ours == theirs:
        return ""
    a, b = [r for r in ours if r not in set(theirs)][:3], [r for r in theirs if r not in set(ours)][:3]
    return f"{len(ours)} and {len(theirs)} rows of {names}; only Spark: {a}; only SQL: {b}"
