"""A copy-on-write store of node and edge tables on Parquet.

Every table is a folder of versions; a write makes a new version and then moves the pointer file, so
readers see the old or the new table and never a mix.  Edges are one table partitioned by type.  The
schema of a version lies beside it, so an emptied table keeps its columns.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlake import model


class Store:
    """Tables under ``path``, a folder on storage that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._staged: dict[str, str] | None = None

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _pointer(self, table: str) -> str | None:
        if self._staged and table in self._staged:
            return self._staged[table]
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(table))) if self._fs.exists(self._at(table)) else []
        marks = [n for n in names if n.startswith("current-")]
        return marks[-1].split("-", 2)[2] if marks else None

    def read(self, table: str) -> DataFrame:
        """The current version; an unwritten core table is empty."""
        version = self._pointer(table)
        if version is None:
            return model.empty(self.spark, table)
        stream = self._fs.open(self._at(f"{table}/schema-{version}"))
        try:
            schema = StructType.fromJson(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}/{version}").select(*schema.names)

    def write(self, table: str, rows: DataFrame) -> None:
        """Replace a table; edges are laid out by type."""
        version = uuid.uuid4().hex[:12]
        out = rows.write.partitionBy("edge_type") if table == "edges" else rows.write
        out.parquet(f"{self.path}/{table}/{version}")
        stream = self._fs.create(self._at(f"{table}/schema-{version}"))
        stream.write(bytearray(rows.schema.json().encode()))
        stream.close()
        if self._staged is not None:
            self._staged[table] = version
        else:
            self._publish(table, version)

    def _publish(self, table: str, version: str) -> None:
        marks = [s.getPath() for s in self._fs.listStatus(self._at(table)) if s.getPath().getName().startswith("current-")]
        number = 1 + max((int(p.getName().split("-")[1]) for p in marks), default=0)
        self._fs.createNewFile(self._at(f"{table}/current-{number:08d}-{version}"))

    def transaction(self, work: Callable[[Store], None]) -> None:
        """Run ``work``; its tables are published together at the end, or none of them if it raises.

        Nested calls join the outer one.
        """
        if self._staged is not None:
            work(self)
            return
        self._staged = {}
        try:
            work(self)
            staged = self._staged
        finally:
            self._staged = None
        for table, version in staged.items():
            self._publish(table, version)

    # -- nodes ------------------------------------------------------------------------------------
    def get(self, ids: Sequence[str]) -> dict[str, DataFrame]:
        """Rows by table, as the ids' prefixes say."""
        tables: dict[str, list[str]] = {}
        for i in ids:
            if ":" not in i:
                raise ValueError(f"not a record id: {i!r}")
            tables.setdefault(i.split(":", 1)[0], []).append(i)
        return {t: self.read(t).where(F.col("id").isin(some)) for t, some in tables.items()}

    def create(self, table: str, rows: DataFrame, ignore: bool = False) -> None:
        """Append new nodes; existing ids raise, or are left alone with ``ignore``."""
        now = self.read(table)
        if ignore:
            rows = rows.join(now.select("id"), "id", "left_anti").dropDuplicates(["id"])
        elif not rows.join(now.select("id"), "id", "left_semi").isEmpty():
            raise ValueError(f"{table}: a node exists already")
        self.write(table, now.unionByName(rows, allowMissingColumns=True))

    def update(self, table: str, patch: DataFrame) -> None:
        """Set the columns of ``patch(id, ...)`` where they are not null."""
        now, fields = self.read(table), [c for c in patch.columns if c != "id"]
        renamed = patch.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
        rows = now.join(renamed, "id", "left")
        self.write(table, rows.select(*[(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c)) for c in now.columns]))

    def delete(self, ids: Sequence[str]) -> None:
        tables: dict[str, list[str]] = {}
        for i in ids:
            tables.setdefault(i.split(":", 1)[0], []).append(i)
        for table, some in tables.items():
            self.write(table, self.read(table).where(~F.col("id").isin(some)))

    # -- edges ------------------------------------------------------------------------------------
    def relate(self, edge: str, pairs: DataFrame) -> None:
        """Add edges (in_id, out_id, ...) of a type; a pair is kept once."""
        rows = pairs.dropDuplicates(["in_id", "out_id"]).withColumn("edge_type", F.lit(edge))
        now = self.read("edges")
        fresh = rows.join(now.select("edge_type", "in_id", "out_id"), ["edge_type", "in_id", "out_id"], "left_anti")
        self.write("edges", now.unionByName(fresh, allowMissingColumns=True))

    def unrelate(self, edge: str, in_id: str | None = None, out_id: str | None = None) -> None:
        """Remove edges of a type by either end or both; without an end nothing is done."""
        if in_id is None and out_id is None:
            return
        hit = F.col("edge_type") == edge
        if in_id is not None:
            hit = hit & (F.col("in_id") == in_id)
        if out_id is not None:
            hit = hit & (F.col("out_id") == out_id)
        self.write("edges", self.read("edges").where(~hit))

    def snapshot(self, path: str, tables: Sequence[str] = ("memory", "tag", "domain", "meta", "edges")) -> None:
        """Write all tables to another folder."""
        for table in tables:
            self.read(table).write.mode("overwrite").parquet(f"{path}/{table}")
