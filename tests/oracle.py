"""Compares queries with their SQL, as values without order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 4) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 4)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both agree."""
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, found = query(spark, sf_dir), db.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, found.fetchall())
    return "" if ours == theirs else f"{sum(ours.values())} rows, {sum(theirs.values())} in SQL; e.g. {list((ours - theirs).items())[:2]} and {list((theirs - ours).items())[:2]}"
