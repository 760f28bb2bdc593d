"""Compare a query with its SQL in DuckDB on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def plain(column):
    if column.dtype == bool:
        return column.astype(float)
    try:
        return column.astype(float)
    except (TypeError, ValueError):
        return column.map(lambda v: None if v is None else str(v))


def tidy(df):
    df = df[sorted(df.columns)].apply(plain)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def assert_same(spark_df, sql, db):
    a, b = tidy(spark_df.toPandas()), tidy(db.sql(sql).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), f"{c}: {a[c][~same].head(3).tolist()} against {b[c][~same].head(3).tolist()}"
