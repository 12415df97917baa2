"""Compare a registered query with its DuckDB SQL, order-insensitively."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return [norm(x) for x in v]
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([norm(r[k]) for k in order]) for r in data)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(folder, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    cur = con.execute(sql)
    return rows([d[0] for d in cur.description], cur.fetchall())
