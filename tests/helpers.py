import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = "/root/testdata/sf0.001"


def duck(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    return round(x, 12) if isinstance(x, float) else x


def rows_of(df) -> list[tuple]:
    """Rows of a Spark or DuckDB result, columns by name, in an order of their own."""
    if hasattr(df, "toPandas"):
        names = sorted(df.columns)
        found = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    else:
        order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
        names = [df.columns[i] for i in order]
        found = [tuple(plain(r[i]) for i in order) for r in df.fetchall()]
    return [tuple(names), *sorted(found, key=repr)]
