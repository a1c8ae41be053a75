"""Language identification with a bit-sliced Bloom filter over character n-grams.

Each of ``POSITIONS`` filter positions holds a bitmask with one bit per language, so ``HASHES`` probes
ANDed together return every language whose filter contains an n-gram.  A text's popcount per
language, less what the language's false-positive rate alone would give, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm import textkernels as K
from memlake.llm.byte_bpe import LETTER, _code_points, code_point_classes
from memlake.plans.scratch import broadcast_if_small, cut

SIZES = (3, 4)
POSITIONS_BITS = 20
HASHES = 2
TRAIN_DOCS = 3000
SALTS = 64
RANGE_BITS = 12
MIN_COUNT = 3
SHARE = 3
UNKNOWN = "und"
_FOLD = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(0x600)], np.uint32)


@dataclass(frozen=True)
class LanguageFilter:
    """``masks``: (words, positions) bit slices; ``rates``: false-positive rate of each language."""

    languages: list[str]
    masks: np.ndarray
    rates: np.ndarray


def _grams(raw: np.ndarray, at: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For each size the n-gram hashes and which are valid; the rows' offsets; has the row a letter.

    Letters are lower-cased, all else is a blank, and each row gets a blank at either end.
    """
    points, _, rows = _code_points(raw, at)
    letter = code_point_classes()[points] == LETTER
    text = np.where(letter, np.where(points < len(_FOLD), _FOLD[np.minimum(points, len(_FOLD) - 1)], points), 32)
    count = len(rows) - 1
    sizes = np.diff(rows)
    bounds = rows + 2 * np.arange(count + 1)
    padded = np.full(bounds[-1], 32, K.U64)
    padded[np.arange(len(points)) + np.repeat(2 * np.arange(count) + 1, sizes)] = text
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(padded))
    out = []
    for size in SIZES:
        hashes = np.zeros(len(padded), K.U64)
        hashes[: max(0, len(padded) - size + 1)] = K.grams(padded, size)
        valid = left >= size
        valid[:-1] &= (padded[:-1] != 32) | (padded[1:] != 32)
        out.append((hashes, valid))
    sums = np.concatenate([[0], np.cumsum(letter)])
    return out, bounds, sums[rows[1:]] > sums[rows[:-1]]


def _probes(hashes: np.ndarray) -> list[np.ndarray]:
    step = 64 // HASHES
    return [((hashes >> K.U64(step * i)) & K.U64((1 << POSITIONS_BITS) - 1)).view(np.int64) for i in range(HASHES)]


def _count(batches) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each block, counted."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lo, hi, raw, at in K.blocks(batch.column("text")):
            grams, bounds, _ = _grams(raw, at)
            by = np.array(langs[lo:hi], object)
            for lang in sorted(set(by)):
                inside = np.repeat(by == lang, np.diff(bounds))
                found, n = np.unique(np.concatenate([h[v & inside] for h, v in grams]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(K.signed(found)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"],
                )


def train_filter(docs: DataFrame, train: Column, per_language: int = TRAIN_DOCS) -> LanguageFilter:
    """Learn from rows of ``docs(doc_id, text, lang)`` where ``train`` holds and lang is not null.

    Fitted on at most ``per_language`` rows of each language, those least in a hash of doc_id (a
    documented bound; scoring covers every row), and of rows with one doc_id and lang on the least text.  An n-gram enters a language's filter if it was seen
    ``MIN_COUNT`` times there and at no less than 1/``SHARE`` of its highest rate in any language.
    """
    usable = train & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    # a language may hold most rows: only those up to the hash range that completes its share, then
    # the least of each salt, then the least of those
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    every = docs.where(usable).select("doc_id", "lang").withColumn("range", F.shiftright(F.xxhash64("doc_id"), 64 - RANGE_BITS))
    ranges = every.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("range")) - F.col("n")
    needed = cut(
        ranges.withColumn("before", before).where(F.col("before") < per_language).groupBy("lang").agg(F.max("range").alias("last")), "ranges"
    )
    chosen = (
        every.join(broadcast_if_small(needed), "lang").where("range <= last").select("doc_id", "lang")
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)))
    )
    for keys in (["lang", "salt"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        chosen = chosen.withColumn("place", place).where(F.col("place") <= per_language)
    chosen = chosen.select("doc_id", "lang").distinct()
    picked = (
        docs.where(usable).join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
        .groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    )
    counts = cut(
        K.bounded(picked.select("lang", "text")).mapInArrow(_count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "grams",
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = (
        rated.where(F.col("n") >= MIN_COUNT).join(best, "gram").where(F.col("rate") * SHARE >= F.col("best"))
        .select("lang", "gram").toPandas()
    )
    languages = sorted(row["lang"] for row in totals.collect())
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    width = 8 * np.dtype(kind).itemsize
    masks = np.zeros((max(1, -(-len(languages) // width)), 1 << POSITIONS_BITS), kind)
    rates = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        grams = np.ascontiguousarray(kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64)).view(K.U64)
        bit = kind(1 << (i % width))
        for place in _probes(grams):
            masks[i // width, place] |= bit
        rates[i] = np.mean(masks[i // width] & bit != 0) ** HASHES
    return LanguageFilter(languages, masks, rates)


def _predict(batches, model) -> Iterator[pa.RecordBatch]:
    known: LanguageFilter = model.value
    width = 8 * known.masks.dtype.itemsize
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, raw, at in K.blocks(batch.column("text")):
            grams, bounds, letters = _grams(raw, at)
            hits = np.zeros((len(known.languages), hi - lo))
            seen = np.zeros(hi - lo)
            for hashes, valid in grams:
                seen += np.add.reduceat(valid, bounds[:-1], dtype=np.int64)
                probes = _probes(hashes)
                for word in range(len(known.masks)):
                    found = known.masks[word][probes[0]]
                    for place in probes[1:]:
                        found &= known.masks[word][place]
                    found[~valid] = 0
                    for i in range(word * width, min(len(known.languages), (word + 1) * width)):
                        bit = known.masks.dtype.type(1 << (i % width))
                        hits[i] += np.add.reduceat(found & bit != 0, bounds[:-1], dtype=np.int64)
            share = hits / np.maximum(seen, 1)
            rates = known.rates[:, None]
            share = np.clip((share - rates) / np.maximum(1 - rates, 1e-9), 0, 1)
            if known.languages:
                best = share.argmax(axis=0)
                total = share.sum(axis=0)
                score = np.where(letters & (total > 0), share.max(axis=0) / np.maximum(total, 1e-12), 0.0)
                named = [known.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
            else:
                score, named = np.zeros(hi - lo), [UNKNOWN] * (hi - lo)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(named, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )


def predict_language(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """(doc_id, lang_pred, score) for every whole text of ``docs(doc_id, text)``.

    score is the winner's share of the corrected popcounts.  A null text, or one without a letter, is
    ``und`` with score 0; so is every text if no language was learned.  A text none of whose n-grams
    is known gets the first language with score 0.  Ties go to the first language by name.  Null and
    repeated ids pass through; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return K.bounded(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")).mapInArrow(
        lambda it: _predict(it, shared), "doc_id bigint, lang_pred string, score double"
    )
