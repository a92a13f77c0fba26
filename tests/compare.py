"""Compares a registered query with its DuckDB oracle, as rows without order."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir: str, query, sql: str):
    """Column lists, then rows that only one side has (at most five of each)."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = con.execute(sql)
    there = rows_of([c[0] for c in result.description], result.fetchall())
    df = query(spark, sf_dir)
    here = rows_of(df.columns, [tuple(r) for r in df.collect()])
    return here[0] == there[0], list((here[1] - there[1]).items())[:5], list((there[1] - here[1]).items())[:5], sum(here[1].values())
