"""The inbox as a Structured Streaming query: micro-batches in, routed and owned memories out.

The checkpoint replaces locks, leases and in-flight marks: a batch that dies is run again with the same
id, and every write of a batch goes to its own folder, so running it again replaces and never doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.functions import text

Handler = Callable[[DataFrame, int], DataFrame]
ENTRY = "id string, text string, request_context string, created_at bigint"


def read_entries(spark: SparkSession, path: str, schema: str = ENTRY, files_per_batch: int = 1) -> DataFrame:
    """Raw entries from a folder that grows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def process_batch(batch: DataFrame, batch_id: int, known: DataFrame | None, handlers: Sequence[Handler]) -> DataFrame:
    """Entries of one batch without exact copies (of stored rows or of each other), through the handlers.

    Copies are told by a hash of the text; of equal texts the least (created_at, id) stays.  A row that
    is earlier than the stored one of its text is kept too, and :func:`stored` then prefers it, so what
    stays does not depend on the order in which files arrive.
    """
    rows = batch.withColumn("content_key", text.short_key(F.coalesce("text", F.lit("")), 32))
    first = rows.groupBy("content_key").agg(F.min(F.struct("created_at", "id")).alias("first"))
    rows = rows.join(first, "content_key").where((F.col("id") == F.col("first.id")) & (F.col("created_at") == F.col("first.created_at"))).drop("first")
    rows = rows.dropDuplicates(["content_key"])
    if known is not None:
        held = known.groupBy("content_key").agg(F.min(F.struct("created_at", "id")).alias("held"))
        rows = rows.join(held, "content_key", "left").where("held is null or struct(created_at, id) < held").drop("held")
    rows = rows.withColumn("context_key", F.coalesce("request_context", F.lit(""))).withColumn("token_count", text.token_count(F.col("text")))
    for handler in handlers:
        rows = handler(rows, batch_id)
    return rows


def run_inbox(entries: DataFrame, target: str, checkpoint: str, handlers: Sequence[Handler] = ()) -> StreamingQuery:
    """Process all that is there (``availableNow``) into ``target/batch=<id>`` folders."""
    spark = entries.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        earlier = stored(spark, target, before=batch_id)
        process_batch(batch, batch_id, earlier, handlers).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return entries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """Rows of finished batches, those before ``before`` if given; None if there are none.

    Of rows with one content key, at most one a batch, the least (created_at, id) counts.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    numbers = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")]
    wanted = sorted(n for n in numbers if before is None or n < before)
    if not wanted:
        return None
    rows = spark.read.parquet(*[f"{target}/batch={n}" for n in wanted])
    order = Window.partitionBy("content_key").orderBy("created_at", "id")
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def attempt_ledger(failures: DataFrame, most: int = 2) -> DataFrame:
    """(batch_key, attempts, state) kept by batch key across micro-batches of (batch_key, error); ``most`` tries in all."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        last = ""
        for frame in frames:
            seen += len(frame)
            if len(frame):
                last = str(frame["kind"].iloc[-1])
        state.update((seen,))
        again = last == "transient" and seen < most
        yield pd.DataFrame({"batch_key": [key[0]], "attempts": [seen], "state": ["retry" if again else "quarantine"]})

    return failures.select("batch_key", text.error_class(F.col("error")).alias("kind")).groupBy("batch_key").applyInPandasWithState(
        count, "batch_key string, attempts long, state string", "attempts long", "update", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts by window and type, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    ).select(F.col("window.start").alias("start"), "event_type", "n", "total")
