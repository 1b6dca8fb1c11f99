"""Rows of a query against those of its SQL."""

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return [_plain(y) for y in x] if isinstance(x, list) else x


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr), cols


def rows_of_sql(sql, folder=DATA):
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in got.fetchall()), key=repr), sorted(names)
