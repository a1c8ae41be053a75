"""Connections: where tables are read from and written to."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Connection:
    kind: str
    location: str
    read_only: bool = False


def parse_connection(text: str) -> Connection:
    """``mem://``, a directory (``dir://`` read-only, ``file://`` or a bare path), an object store or JDBC url."""
    m = re.fullmatch(r"([a-z0-9+]+)://(.*)", text)
    if not m:
        return Connection("path", text)
    scheme, rest = m[1], m[2]
    if scheme == "mem":
        return Connection("memory", rest)
    if scheme in ("postgres", "postgresql"):
        return Connection("jdbc", f"jdbc:postgresql://{rest}")
    if scheme == "dir":
        return Connection("path", rest, read_only=True)
    if scheme == "s3":
        return Connection("path", f"s3a://{rest}")
    return Connection("path", text)


def read_table(spark: SparkSession, connection: Connection, table: str, timeout_s: int = 60, **options: str) -> DataFrame:
    """A table: a view, a Parquet folder, or a JDBC table whose reads are bounded by ``timeout_s``.

    Give ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` to read JDBC in parallel.
    """
    if connection.kind == "memory":
        return spark.table(table)
    if connection.kind == "jdbc":
        return spark.read.format("jdbc").options(url=connection.location, dbtable=table, queryTimeout=str(timeout_s), **options).load()
    return spark.read.parquet(f"{connection.location.rstrip('/')}/{table}.parquet")


def write_table(rows: DataFrame, connection: Connection, table: str, mode: str = "errorifexists") -> None:
    if connection.read_only:
        raise PermissionError(f"{connection.location} is read-only")
    if connection.kind == "memory":
        rows.createOrReplaceTempView(table)
    elif connection.kind == "jdbc":
        rows.write.format("jdbc").options(url=connection.location, dbtable=table).mode(mode).save()
    else:
        rows.write.mode(mode).parquet(f"{connection.location.rstrip('/')}/{table}.parquet")


def query(spark: SparkSession, sql: str, params: Mapping[str, Any] | list | None = None) -> DataFrame:
    """Parameterised SQL, by name (``:x``) or position (``?``)."""
    return spark.sql(sql, args=params) if params else spark.sql(sql)


def read_json_params(path: str) -> Any:
    """A filter or parameter file."""
    with open(path) as f:
        return json.load(f)


def render(rows: DataFrame, style: str = "markdown", limit: int = 1000) -> str:
    """A result for people: ``json``, ``text`` or a Markdown table (null as a dash, floats with 3 digits)."""
    taken, columns = rows.limit(limit).collect(), rows.columns
    if style == "json":
        return json.dumps({"columns": columns, "rows": [r.asDict(True) for r in taken]}, default=str)

    def cell(v: Any) -> str:
        if v is None:
            return "—"
        if isinstance(v, bool):
            return "yes" if v else "no"
        return f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")

    lines = [[cell(v) for v in row] for row in taken]
    if style == "text":
        return "\n".join("\t".join(line) for line in lines)
    return "\n".join(["| " + " | ".join(x) + " |" for x in (columns, ["---"] * len(columns), *lines)])
