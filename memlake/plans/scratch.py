"""Shared scratch tables and size-checked broadcasts.

Lineage is cut by writing Parquet into the folder that ``spark.checkpoint.dir`` names, which the
driver and all executors share, so a lost executor only costs a re-read.  A folder of our own is
used only where the setting is absent and Spark runs in one process (local tests).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOCAL_DEFAULT = "/tmp/checkpoints"
BROADCAST_ROWS = 1_000_000
SALTS = 16


def scratch_root(spark: SparkSession) -> str:
    """The scratch folder of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL_DEFAULT
    return f"{base.rstrip('/')}/memlake-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, label: str = "t", **options: str) -> DataFrame:
    """Write ``df`` once into the scratch folder and read it back: a recoverable lineage cut.

    ``options`` go to the Parquet writer (sizes of row groups, say).
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def counted(df: DataFrame, label: str = "t", **tallies: Column) -> DataFrame:
    """:func:`cut`, with the rows counted as they are written, so that :func:`rows_of` runs no query of its own.

    A query more for each table is plans, stages and classes more in the driver.  ``tallies`` are further
    aggregates over the rows written, returned in ``scratch_seen``.
    """
    seen = Observation()
    table = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in tallies.items()]), label)
    table.scratch_seen = seen.get
    table.scratch_rows = table.scratch_seen["rows"]
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`cut` wrote, once what was made of them has been cut as well."""
    for table in tables:
        if path := getattr(table, "scratch_path", None):
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it when no frame built on them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_of(table: DataFrame) -> int:
    """The number of rows of a written table, counted as it was written (:func:`counted`) or once for each frame object."""
    if not hasattr(table, "scratch_rows"):
        table.scratch_rows = table.count()
    return table.scratch_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only when a counted, already written narrow table has at most ``max_rows``.

    ``df`` should come from :func:`counted`, or from :func:`cut`, so the count reads Parquet footers alone; ``rows`` is
    the count where the caller knows it.  A larger table is returned as it is and joins by shuffle.
    """
    return F.broadcast(df) if (rows_of(df) if rows is None else rows) <= max_rows else df


def join_hot(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS, rows: int | None = None
) -> DataFrame:
    """``left`` joined with a written table that has each key once, however often ``left`` has one key.

    A small ``right`` (``rows``, where the caller knows the count) is broadcast.  A larger one is repeated
    ``SALTS`` times, so that the rows of a hot key are dealt, by a hash of the whole row, to as many tasks;
    ``how`` may be inner, left, left_semi or left_anti.
    """
    if (rows_of(right) if rows is None else rows) <= max_rows:
        return left.join(F.broadcast(right), keys, how)
    salt = "__salt"
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return dealt.join(copies, [*keys, salt], how).drop(salt)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written down with a bigint key of its own for each row, and the key's column name."""
    name = "row_key"
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return cut(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
