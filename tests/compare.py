"""Compare a registered query with its SQL, row by row, order aside."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


# Spark type -> the DuckDB type it must meet.
SAME_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def differences(spark_df, connection, sql: str) -> list[str]:
    found = []
    oracle = connection.sql(sql)
    types = {c: SAME_TYPES.get(t, t) for c, t in spark_df.dtypes}
    oracle_types = {c: str(t) for c, t in zip(oracle.columns, oracle.types)}
    if types != oracle_types:
        found.append(f"schema: {types} != {oracle_types}")
    ours = _rows(spark_df.columns, spark_df.collect())
    theirs = _rows(oracle.columns, oracle.fetchall())
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        found.append(
            f"rows: {sum(ours.values())} vs {sum(theirs.values())}; "
            f"{sum(extra.values())} only in Spark, e.g. {[str(r)[:300] for r in list(extra)[:2]]}; "
            f"{sum(missing.values())} only in SQL, e.g. {[str(r)[:300] for r in list(missing)[:2]]}"
        )
    return found
