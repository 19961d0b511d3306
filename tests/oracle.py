"""Run a registered query in Spark and its SQL in DuckDB, and compare the rows."""

import duckdb
from pyspark.sql import DataFrame

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
DATA = "/root/testdata"


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def spark_rows(df: DataFrame):
    names = sorted(df.columns)
    assert len(set(names)) == len(names)
    return names, sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def sql_rows(con, sql: str):
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    names = sorted(found)
    order = [found.index(n) for n in names]
    return names, sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
