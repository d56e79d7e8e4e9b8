"""A query's rows beside those of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return str(v)
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def both(spark, query, sql, folder):
    df = query(spark, folder)
    mine = (sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()]))
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    r = con.sql(sql)
    return mine, (sorted(r.columns), rows(r.columns, r.fetchall()))
