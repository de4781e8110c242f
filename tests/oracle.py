"""Runs a query on Spark and its SQL on DuckDB and compares all values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            src = f"{p}/*.parquet" if os.path.isdir(p) else p
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{src}'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(df, sql: str, sf_dir: str) -> tuple[int, list]:
    """(rows, differing rows); asserts equal columns."""
    names, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duck(sf_dir)
    cur = con.execute(sql)
    theirs_names = [d[0] for d in cur.description]
    other_names, theirs = rows_of(theirs_names, cur.fetchall())
    assert names == other_names, (names, other_names)
    from collections import Counter

    a, b = Counter(mine), Counter(theirs)
    return len(mine), [("spark", x) for x in (a - b)][:5] + [("sql", x) for x in (b - a)][:5]
