"""Comparison of a query with its SQL on the same Parquet files."""

import os

import duckdb

SF_DIR = "/root/testdata/sf0.001"


def _cell(v):
    if v is None or isinstance(v, float) and v != v:
        return "NULL"
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    return str(v)


def rows_of_sql(sql, sf_dir=SF_DIR):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(_cell(r[i]) for i in order) for r in found.fetchall())


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_cell(r[n]) for n in names) for r in df.collect())
