"""Compares a query's rows with those of its SQL."""

import math
from collections import Counter
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.01"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, list) else v


def rows_of_sql(sql: str, sf: str = SF):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return [found.columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def rows_of(df):
    order = sorted(df.columns)
    return order, Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
