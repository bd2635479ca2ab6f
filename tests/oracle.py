"""Comparison of a Spark result with DuckDB's result of the matching SQL."""

from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, Decimal):
        return f"decimal {value}"
    if isinstance(value, float):
        return "0.0" if value == 0 else repr(value)
    return repr(value)


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(df, connection, sql):
    """None if names and all values are equal, else a short description."""
    relation = connection.execute(sql)
    names = [column[0] for column in relation.description]
    expected = _sorted_rows(names, relation.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    found = _sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    if len(found) != len(expected):
        return f"{len(found)} rows instead of {len(expected)}: {found[:2]} / {expected[:2]}"
    unequal = [(a, b) for a, b in zip(found, expected) if a != b]
    return f"{len(unequal)} rows differ, first {unequal[0]}" if unequal else None
