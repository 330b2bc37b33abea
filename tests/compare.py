"""Runs queries beside their DuckDB SQL as the driver does: rows as sorted text, columns by name."""

from __future__ import annotations

import math

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{round(float(v), 6):.6f}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def difference(spark, con, sf_dir: str, query, sql: str):
    """None if both give the same rows and columns, else what differs."""
    df = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return sorted(df.columns), sorted(names)
    a, b = rows_of(df.columns, df.collect()), rows_of(names, cur.fetchall())
    if a == b:
        return None
    only = lambda x, y: sorted(set(x) - set(y))[:3]
    return len(a), len(b), only(a, b), only(b, a)
