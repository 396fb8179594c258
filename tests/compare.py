"""Run a registered query on Spark and its statement on DuckDB, and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0 if value else 0.0)
    return str(value)


def _rows(table):
    names = sorted(table.column_names)
    columns = [table[n].to_pylist() for n in names]
    return names, sorted(tuple(map(_cell, row)) for row in zip(*columns))


def difference(df, con, statement: str) -> str | None:
    """None when names, types and rows agree, else what differs."""
    mine, theirs = df.toArrow(), con.sql(statement).to_arrow_table()
    my_types = {f.name: str(f.type) for f in mine.schema}
    their_types = {f.name: str(f.type) for f in theirs.schema}
    if my_types != their_types:
        return f"schema {my_types} / {their_types}"
    (names, left), (_, right) = _rows(mine), _rows(theirs)
    if left == right:
        return None
    only_left = sorted(set(left) - set(right))[:3]
    only_right = sorted(set(right) - set(left))[:3]
    return f"{names}: {len(left)} / {len(right)} rows; only spark {str(only_left)[:600]}; only duckdb {str(only_right)[:600]}"
