"""A query's rows against its SQL's rows in DuckDB, whatever their order."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return repr([plain(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float | np.floating) and v != v):
        return ""
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, int | float | np.integer | np.floating):
        return repr(float(v))
    return str(v).replace(" 00:00:00", "")


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None))


def same(spark_df, con, sql: str) -> None:
    got, want = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, ([x for x in a if x not in b][:3], [x for x in b if x not in a][:3])
