"""Compare a Spark result with DuckDB's for the same tables: names, row counts and values, in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def value(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or v.__class__.__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.5f}".replace("-0.00000", "0.00000")
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def difference(frame, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    relation = con.sql(sql)
    columns, rows = list(relation.columns), relation.fetchall()
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} and {sorted(columns)}"
    mine, other = canonical(frame.columns, frame.collect()), canonical(columns, rows)
    if mine == other:
        return ""
    odd = [r for r in mine if r not in set(other)][:2], [r for r in other if r not in set(mine)][:2]
    return f"{len(mine)} and {len(other)} rows; only here {odd[0]}, only in the oracle {odd[1]}"
