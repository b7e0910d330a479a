"""Compares a Spark result with DuckDB's, order aside, values hashed by their rounded text."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path("/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns: list[str], values) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(plain(v[i])) for i in order) for v in values)


def difference(df, sql: str, sf_dir: str):
    """(columns equal, rows only here, rows only there)."""
    relation = connect(sf_dir).sql(sql)
    a, b = rows(df.columns, df.collect()), rows(relation.columns, relation.fetchall())
    return sorted(df.columns) == sorted(relation.columns), a - b, b - a
