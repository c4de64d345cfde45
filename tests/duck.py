"""Compare a DataFrame with what DuckDB makes of SQL over the same tables."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder, **frames):
    connection = duckdb.connect()
    for name in TABLES:
        if name in frames:
            connection.register(name, frames[name])
        elif folder:
            connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.astype(object).values.tolist():
        rows.append(tuple(None if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)) else x for x in row))
    return sorted(rows, key=repr)


def assert_same(spark_frame, sql, connection):
    found, wanted = spark_frame.toPandas(), connection.sql(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    a, b = plain(found), plain(wanted)
    assert len(a) == len(b)
    assert [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3] == []
