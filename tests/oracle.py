"""Compares a query's rows with those of its SQL in DuckDB."""

import math
import os
from collections import Counter


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(cell(r[c]) for c in cols) for r in df.collect())


def sql_rows(sql, folder):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], Counter(tuple(cell(r[k]) for k in order) for r in got.fetchall())


def check(query, sql, spark, folder):
    assert spark_rows(query(spark, folder)) == sql_rows(sql, folder)
