"""Comparison of a query with its SQL."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def expected(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    names = sorted(found.columns)
    rows = found.project(", ".join(f'"{c}"' for c in names)).fetchall()
    return names, sorted(repr(tuple(plain(v) for v in r)) for r in rows)


def actual(df):
    names = sorted(df.columns)
    rows = df.select(*[df[f"`{c}`"] for c in names]).collect()
    return names, sorted(repr(tuple(plain(v) for v in r)) for r in rows)
