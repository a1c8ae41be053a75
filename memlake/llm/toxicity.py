"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and L1 sparsity leave few non-zero weights, which are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm import textkernels as K
from memlake.plans.scratch import broadcast_if_small, counted, cut

FEATURE_BITS = 20
TRAIN_ROWS = 10_000
TRAIN_BYTES = 1 << 13
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
UNTAUGHT = -35.0


@dataclass(frozen=True)
class Weights:
    """Bias, and the non-zero weights by feature."""

    bias: float
    index: np.ndarray
    weight: np.ndarray


def _features(words: K.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word place, feature) of unigrams, bigrams and one-word skip-grams that stay within a row.

    Words are runs of letters and digits (all but ASCII signs); case is folded for A-Z.
    """
    h, row = words.hashes, words.rows()
    shift = K.U64(64 - FEATURE_BITS)
    yield np.arange(len(h)), (h >> shift).view(np.int64)
    for gap, seed in ((1, 0xD1B54A32D192ED03), (2, 0xABC98388FB8FAC03)):
        first = np.flatnonzero(row[:-gap] == row[gap:]) if len(h) > gap else np.empty(0, np.int64)
        joined = K.mix(h[first] * K.U64(seed) + h[first + gap])
        yield first, (joined >> shift).view(np.int64)


def _examples(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("label")
        for lo, hi, raw, at in K.blocks(batch.column("text")):
            words = K.Words(raw, at, blank=K.SIGNS)
            row = words.rows()
            pairs = np.concatenate([row[p] << FEATURE_BITS | f for p, f in _features(words)])
            pairs = np.unique(pairs)
            ends = np.searchsorted(pairs, np.arange(hi - lo + 1) << FEATURE_BITS)
            flat = pa.array((pairs & ((1 << FEATURE_BITS) - 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [label.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                ["label", "features"],
            )


def ftrl(examples: list[tuple[int, np.ndarray]], epochs: int = EPOCHS) -> Weights:
    """FTRL-proximal over (label, distinct feature indices), in the given order.

    Of no examples nothing is learned: the bias then says that no text is toxic.
    """
    if not examples:
        return Weights(UNTAUGHT, np.empty(0, np.int64), np.empty(0, np.float32))
    size = 1 << FEATURE_BITS
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        w = -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(own) <= L1, 0.0, w)

    for _ in range(epochs):
        for label, at in examples:
            w = weights(at)
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            total = min(35.0, max(-35.0, bias + w.sum()))
            error = 1.0 / (1.0 + np.exp(-total)) - label
            square = error * error
            was = n[at]
            z[at] += error - (np.sqrt(was + square) - np.sqrt(was)) / ALPHA * w
            n[at] = was + square
            bias_z += error - (np.sqrt(bias_n + square) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += square
    used = np.flatnonzero(np.abs(z) > L1)
    return Weights(float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)), used, weights(used).astype(np.float32))


def train_toxicity(docs: DataFrame, labels: DataFrame, train: Column, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Weights:
    """Learn ``labels.toxic`` from at most ``rows`` labelled documents where ``train`` holds.

    The bound is one for both classes, so the share of toxic documents that is learned, and with it who is
    toxic at 0.5, does not depend on the size of the table.  The documents are those least in a hash of
    doc_id, so the choice is stable; those of more than ``size`` bytes teach nothing, which bounds what is
    learned from.  A null text is an empty one; null labels and ids are not used; a doc_id with both labels
    teaches both; of rows with one doc_id the least text teaches.  Without any label no text is predicted
    toxic (score about 0).
    """
    known = labels.where(train & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label")
    ).distinct()
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    present = ids.select("doc_id").join(broadcast_if_small(counted(known, "toxic-labels")), "doc_id").distinct()
    chosen = cut(present.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows), "toxic-sample")
    rows = (
        ids.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= size)
        .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    )
    found = K.bounded(rows.select(F.col("label").cast("int").alias("label"), "text")).mapInArrow(_examples, "label int, features array<int>").toArrow()
    examples = []
    for batch in found.to_batches():  # views of what came, no copy
        flat = batch.column("features")
        ends = np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        every = flat.flatten().to_numpy(zero_copy_only=False)
        examples += [(y, every[a:b]) for y, a, b in zip(batch.column("label").to_pylist(), ends[:-1], ends[1:])]
    # rows arrive in any order; this one depends on their contents alone
    examples.sort(key=lambda e: (int(K.mix(e[1].astype(K.U64)).sum()), e[0]))
    return ftrl(examples)


def _score(batches, weights) -> Iterator[pa.RecordBatch]:
    model: Weights = weights.value
    table = np.zeros(1 << FEATURE_BITS, np.float32)
    table[model.index] = model.weight
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, raw, at in K.blocks(batch.column("text")):
            words = K.Words(raw, at, blank=K.SIGNS)
            row = words.rows()
            hit = []
            for place, feature in _features(words):
                some = table[feature] != 0
                hit.append(row[place[some]] << FEATURE_BITS | feature[some])
            pairs = np.unique(np.concatenate(hit))
            total = np.bincount(pairs >> FEATURE_BITS, table[pairs & ((1 << FEATURE_BITS) - 1)], hi - lo) + model.bias
            score = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )


def score_toxicity(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, score, predicted) for every whole text of ``docs(doc_id, text)``.

    A null or empty text has no features and gets the bias alone.  Null and repeated ids pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return K.bounded(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")).mapInArrow(
        lambda it: _score(it, shared), "doc_id bigint, score double, predicted int"
    )


def drop_toxic(docs: DataFrame, weights: Weights) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def keep(batches):
        for batch in batches:
            ids = pa.array(np.arange(len(batch)), pa.int64())
            part = pa.RecordBatch.from_arrays([ids, batch.column("text")], ["doc_id", "text"])
            scored = list(_score([part], shared))
            bad = np.concatenate([s.column("predicted").to_numpy(zero_copy_only=False) for s in scored]) if scored else np.empty(0)
            yield batch.filter(pa.array(bad == 0))

    return K.bounded(docs).mapInArrow(keep, docs.schema)
