"""Compare a query with its DuckDB twin, as multisets of rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(v + 0.0, ".9g")
    return str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(norm(x) for x in r) for r in frame[cols].itertuples(index=False))


def same(query, sql, spark, folder):
    assert rows(query(spark, folder).toPandas()) == rows(connect(folder).execute(sql).fetchdf())
