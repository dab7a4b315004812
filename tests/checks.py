"""Compare a query with its SQL twin: same columns, same rows in any order."""

from __future__ import annotations

import math

import duckdb

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def rows(df, *order):
    """Rows as plain tuples, sorted when columns are named."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float) and (math.isnan(value) or math.isinf(value)):
        return str(value)
    try:
        number = float(value)
    except (TypeError, ValueError):
        return value
    return number if number != int(number) else int(number)


def table_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def difference(spark_df, connection, sql: str) -> str | None:
    """None when equal, else what differs first."""
    left = table_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    right = table_rows(names, result.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows; {left[:2]} / {right[:2]}"
    for a, b in zip(left, right):
        if a != b:
            return f"{a} != {b}"
    return None
