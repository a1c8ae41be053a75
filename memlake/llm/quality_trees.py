"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are numpy passes over blocks of an Arrow column.  Trees are grown on a bounded
sample of labelled rows, level by level, from histograms of gradients over quantile bins; they are then
flattened into arrays (a full binary tree each), so that scoring is ``DEPTH`` vectorised steps a tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm import textkernels as K
from memlake.plans.scratch import broadcast_if_small, cut

TRAIN_ROWS = 20_000
BINS = 64
TREES, DEPTH = 80, 5
RATE, RIDGE, MIN_LEAF, MIN_GAIN = 0.15, 1.0, 10, 1e-3
THRESHOLD = 0.3
UNTAUGHT = 35.0

#: Bytes of each kind whose share of the text is a statistic.
KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".!?", "comma": b",;:", "quote": b"'\"()",
    "hash": b"#", "percent": b"%", "ampersand": b"&", "star": b"*", "dollar": b"$", "pipe": b"|", "brace": b"{}[]<>\\/=_@^~`+-",
    "bang": b"!", "line": b"\n", "blank": b" \t", "other": range(128, 256),
}
NAMES = [
    *KINDS, "log_bytes", "log_words", "word_bytes", "word_spread", "distinct_words", "common_word", "short_words", "long_words",
    "capitalised", "signed_words", "line_words", "distinct_lines", "repeated_pairs",
]


@dataclass(frozen=True)
class Forest:
    """Bin edges by statistic, and the trees: rows of full binary trees in level order.

    An inner node sends a row right if the bin of its ``feature`` is above ``cut``; a node that does not
    split has the greatest cut, so all go left.  ``leaf`` holds the steps in log odds, rate included.
    """

    edges: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float


def _per_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, values, rows)


def _distinct(keys: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """By row: how many different keys there are, and how often the commonest one occurs."""
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    start = np.flatnonzero(first)
    runs = np.diff(np.append(start, len(k)))
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, r[start], runs)
    return np.bincount(r[start], minlength=rows), most


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of statistics (``NAMES``) for each text of a block; an empty text has zeros."""
    rows = len(at) - 1
    size = np.diff(at).astype(float)
    some = np.maximum(size, 1)
    out = np.zeros((rows, len(NAMES)))
    counts = np.bincount(np.repeat(np.arange(rows) << 8, np.diff(at)) + raw, minlength=rows << 8).reshape(rows, 256)
    for k, kind in enumerate(KINDS.values()):
        out[:, k] = counts[:, list(kind)].sum(axis=1) / some
    words = K.Words(raw, at, lower=False)
    row = words.rows()
    n = np.diff(words.at)
    many = np.maximum(n, 1)
    length = (words.ends - words.starts).astype(float)
    mean = _per_row(length, row, rows) / many
    spread = np.sqrt(np.maximum(_per_row(length * length, row, rows) / many - mean * mean, 0))
    different, most = _distinct(words.hashes, row, rows)
    first = raw[words.starts] if len(raw) else raw
    last = raw[words.ends - 1] if len(raw) else raw
    pairs = K.grams(words.hashes, 2)
    within = np.flatnonzero(row[:-1] == row[1:]) if len(row) > 1 else np.empty(0, np.int64)
    different_pairs, _ = _distinct(pairs[within], row[within], rows)
    breaks = np.flatnonzero(raw == 10)
    of = np.searchsorted(at, breaks, "right") - 1
    lines = np.bincount(of, minlength=rows) + 1
    # a line's hash is that of its words
    opens = np.zeros(len(words.starts) + 1, np.int64)
    opens[:-1] = np.searchsorted(breaks, words.starts)
    fresh = np.ones(len(words.starts), bool)
    fresh[1:] = (opens[1:-1] != opens[:-2]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(fresh)
    place = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
    mixed = K.mix(words.hashes + place.astype(K.U64) * K.U64(0x9E3779B97F4A7C15))
    line_hash = np.add.reduceat(mixed, begin) if len(begin) else mixed
    full = np.bincount(row[begin], minlength=rows)
    different_lines, _ = _distinct(line_hash, row[begin], rows)
    upper = (first >= 65) & (first <= 90)
    plain = ~K.SIGNS[last] | np.isin(last, list(b".,;:!?"))
    out[:, len(KINDS):] = np.stack([
        np.log1p(size), np.log1p(n), mean, spread, different / many, most / many, _per_row(length <= 3, row, rows) / many,
        _per_row(length > 12, row, rows) / many, _per_row(upper, row, rows) / many, _per_row(~plain, row, rows) / many,
        n / lines, different_lines / np.maximum(full, 1), 1 - different_pairs / np.maximum(n - 1, 1),
    ], axis=1)
    return out


def _examples(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("label")
        for lo, hi, raw, at in K.blocks(batch.column("text")):
            rows = statistics(raw, at)
            ends = pa.array(np.arange(hi - lo + 1) * rows.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [label.slice(lo, hi - lo), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], ["label", "statistics"]
            )


def bin_edges(values: np.ndarray) -> np.ndarray:
    """Inner edges of at most ``BINS`` quantile bins by statistic (columns); unused edges are infinite."""
    out = np.full((BINS - 1, values.shape[1]), np.inf)
    for k, column in enumerate(values.T):
        edges = np.unique(np.quantile(column, np.arange(1, BINS) / BINS))
        out[: len(edges), k] = edges
    return out


def to_bins(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each value: how many of its statistic's edges lie under it."""
    return np.stack([np.searchsorted(edges[:, k], values[:, k], "left") for k in range(values.shape[1])], axis=1).astype(np.uint8)


def _grow(bins: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree: feature and cut of inner nodes, values of leaves, and the leaf of each row."""
    rows, width = bins.shape
    feature = np.zeros((1 << DEPTH) - 1, np.int16)
    cuts = np.full((1 << DEPTH) - 1, 255, np.uint8)
    node = np.zeros(rows, np.int64)
    column = np.arange(width)
    for level in range(DEPTH):
        wide = 1 << level
        key = ((node[:, None] * width + column) * BINS + bins).ravel()
        shape = (wide, width, BINS)
        g = np.bincount(key, np.repeat(slope, width), wide * width * BINS).reshape(shape).cumsum(axis=2)
        h = np.bincount(key, np.repeat(curve, width), wide * width * BINS).reshape(shape).cumsum(axis=2)
        n = np.bincount(key, minlength=wide * width * BINS).reshape(shape).cumsum(axis=2)
        score = lambda a, b: a * a / (b + RIDGE)
        gain = score(g, h) + score(g[:, :, -1:] - g, h[:, :, -1:] - h) - score(g[:, :, -1:], h[:, :, -1:])
        gain[(n < MIN_LEAF) | (n[:, :, -1:] - n < MIN_LEAF)] = 0
        flat = gain.reshape(wide, -1)
        best = flat.argmax(axis=1)
        splits = flat[np.arange(wide), best] > MIN_GAIN
        at = slice(wide - 1, 2 * wide - 1)
        feature[at] = np.where(splits, best // BINS, 0)
        cuts[at] = np.where(splits, best % BINS, 255)
        node = 2 * node + (bins[np.arange(rows), feature[at][node]] > cuts[at][node])
    leaf = -np.bincount(node, slope, 1 << DEPTH) / (np.bincount(node, curve, 1 << DEPTH) + RIDGE)
    return feature, cuts, leaf * RATE, node


def grow_forest(values: np.ndarray, label: np.ndarray, trees: int = TREES) -> Forest:
    """Boosted trees on log loss.  Of no examples nothing is learned: every text is then good."""
    empty = Forest(np.full((BINS - 1, len(NAMES)), np.inf), *(np.zeros((0, w), t) for w, t in (((1 << DEPTH) - 1, np.int16), ((1 << DEPTH) - 1, np.uint8), (1 << DEPTH, float))), UNTAUGHT)
    if not len(label):
        return empty
    share = min(max(label.mean(), 1e-6), 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    edges = bin_edges(values)
    bins = to_bins(values, edges)
    total = np.full(len(label), bias)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        feature, cuts, leaf, node = _grow(bins, p - label, p * (1 - p))
        total += leaf[node]
        grown.append((feature, cuts, leaf))
    return Forest(edges, *(np.stack(x) for x in zip(*grown)), bias)


def traverse(forest: Forest, values: np.ndarray) -> np.ndarray:
    """Log odds of every row: all rows go down a tree together, one level at a time."""
    bins = to_bins(values, forest.edges)
    every = np.arange(len(values))
    total = np.full(len(values), forest.bias)
    for feature, cuts, leaf in zip(forest.feature, forest.cut, forest.leaf):
        node = np.zeros(len(values), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (bins[every, feature[node]] > cuts[node])
        total += leaf[node - len(feature)]
    return total


def train_quality(docs: DataFrame, labels: DataFrame, train: Column, rows: int = TRAIN_ROWS) -> Forest:
    """Learn ``labels.quality`` from at most ``rows`` labelled documents for which ``train`` holds.

    The bound is one for both classes, so the share of good documents that is learned does not depend on
    the size of the table; the documents are those least in a hash of doc_id.  A null text is an empty
    one; null labels and ids are not used; a doc_id with both labels teaches both; of rows with one doc_id
    the least text teaches.  Without labels every text is good.
    """
    known = labels.where(train & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label")
    ).distinct()
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    present = ids.select("doc_id").join(broadcast_if_small(cut(known, "quality-labels")), "doc_id").distinct()
    chosen = cut(present.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows), "quality-sample")
    texts = (
        ids.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    )
    found = K.bounded(texts.select("label", "text")).mapInArrow(_examples, "label int, statistics array<double>").toArrow()
    values = found.column("statistics").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    label = found.column("label").to_numpy().astype(float)
    order = np.lexsort((label, *values.T))  # rows arrive in any order; this one depends on their contents alone
    return grow_forest(values[order], label[order])


def _score(batches, shared) -> Iterator[pa.RecordBatch]:
    forest: Forest = shared.value
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, raw, at in K.blocks(batch.column("text")):
            score = 1 / (1 + np.exp(-np.clip(traverse(forest, statistics(raw, at)), -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )


def score_quality(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score, predicted) for every whole text of ``docs(doc_id, text)``.

    A null text is an empty one, scored by the same trees; null and repeated ids pass through, one row
    each.  The broadcast forest has ``TREES`` * 2 ** ``DEPTH`` nodes, whatever was learned from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    return K.bounded(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")).mapInArrow(
        lambda it: _score(it, shared), "doc_id bigint, score double, predicted int"
    )
