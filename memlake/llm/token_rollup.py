"""Delta-maintained token counts.

A batch of signed events (insert, delete, revise) becomes additive deltas by source, language and
tokenizer version.  A batch is one directory under the ledger, replaced as a whole, and counts once:
committing a batch id again changes nothing, so a job that died may be run again as it is.  Every
``FOLD_AFTER`` batches the totals so far are written down, and later reads start from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import textkernels as K
from memlake.llm.byte_bpe import Encoder, Vocabulary, load_ranks

KEYS = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
FOLD_AFTER = 16
_EVENTS = ("op", *KEYS, "n_tokens", "old_tokens")


def deltas(events: DataFrame) -> DataFrame:
    """Signed totals of events (op, source, lang, tokenizer, n_tokens, old_tokens).

    ``insert`` adds a document and its tokens, ``delete`` takes both away, ``revise`` adds
    n_tokens - old_tokens and no document.  Null counts are 0, null keys a group of their own; any
    other op adds nothing.  Sums are combined before the shuffle, so a hot source costs no more.
    """
    n, old = (F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_tokens", "old_tokens"))
    none = F.lit(0).cast("bigint")
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    change = F.when(F.col("op").isin("insert", "delete"), sign * n).when(F.col("op") == "revise", n - old).otherwise(none)
    return events.groupBy(*KEYS).agg(F.sum(sign.cast("bigint")).alias("n_docs"), F.sum(change).alias("n_tokens"))


class Ledger:
    """Committed deltas in a folder on storage that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _written(self, prefix: str) -> list[str]:
        """What follows ``prefix`` in the names of the ledger's finished folders."""
        if not self._fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(n[len(prefix):] for n in names if n.startswith(prefix) and self._fs.exists(self._at(f"{n}/_SUCCESS")))

    @staticmethod
    def _folder(batch: str) -> str:
        """A batch id as one path element: all but letters, digits and ``_.-~`` is percent-encoded."""
        name = quote(batch, safe="")
        if not 0 < len(name) <= 200:
            raise ValueError(f"a batch id must have 1 to 200 characters once encoded: {batch!r}")
        return f"batch={name}"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._at(f"{self._folder(batch)}/_SUCCESS"))

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply a batch once; False if a batch of that id was applied before, whatever it held.

        A half-written batch is replaced.  Changed content needs an id of its own (deletes and
        revisions); any non-empty string is an id, unless it is too long for a folder's name.
        One writer at a time.
        """
        if self.committed(batch):
            return False
        deltas(events.select(*_EVENTS)).write.mode("overwrite").parquet(f"{self.path}/{self._folder(batch)}")
        if len(self._state()[1]) >= FOLD_AFTER:
            self.fold()
        return True

    def batches(self) -> list[str]:
        """The ids of all committed batches."""
        return [unquote(n) for n in self._written("batch=")]

    def _state(self) -> tuple[str | None, list[str]]:
        """The last written totals, if any, and the batches that they do not hold yet."""
        held: set[str] = set()
        folds = [n for n in self._written("totals=") if self._fs.exists(self._at(f"folded={n}/_SUCCESS"))]
        if folds:
            held = {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/folded={folds[-1]}").collect()}
        return (folds[-1] if folds else None), [n for n in self._written("batch=") if n not in held]

    def fold(self) -> None:
        """Write the totals and the batches they hold; both count only once both are whole.

        A batch keeps its folder, which is what makes it count once.
        """
        last, _ = self._state()
        name = f"{int(last or 0) + 1:09d}"
        held = [(n,) for n in self._written("batch=")]
        totals = self.totals()
        self.spark.createDataFrame(held, "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/folded={name}")
        totals.write.mode("overwrite").parquet(f"{self.path}/totals={name}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches; emptied groups go."""
        last, rest = self._state()
        paths = [f"{self.path}/totals={last}"] * (last is not None) + [f"{self.path}/batch={n}" for n in rest]
        if not paths:
            return self.spark.createDataFrame([], _DELTA)
        every = self.spark.read.schema(_DELTA).parquet(*paths)
        summed = every.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")


def _count(batches, vocab) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(vocab.value)
    for batch in batches:
        for lo, hi, raw, at in K.blocks(batch.column("text")):
            words = K.Words(raw, at)
            h1, h2 = K.sequence_keys(K.Words(raw, at, lower=False))
            _, ends = encoder.block(raw, at)
            keep = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "source", "lang")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(K.signed(h1)), pa.array(K.signed(h2)), pa.array(np.diff(words.at).astype(np.int64)),
                 pa.array(np.diff(ends).astype(np.int64))],
                ["doc_id", "source", "lang", "h1", "h2", "words", "bpe"],
            )


def count_tokens(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, source, lang, h1, h2, words, bpe) of each whole text: two counts and a content key."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(load_ranks(ranks_path)))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), "text",
    )
    return K.bounded(rows).mapInArrow(
        lambda it: _count(it, vocab),
        "doc_id bigint, source string, lang string, h1 bigint, h2 bigint, words bigint, bpe bigint",
    )
