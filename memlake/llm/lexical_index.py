"""Ranked lexical search: an index sharded by document, with integer impacts computed when it is built.

A shard holds some consecutive documents of one task as compressed sparse rows: its distinct terms, and
for each the places and impacts of the documents that have it.  A search broadcasts a block of items with
their term weights; every shard then adds up whole posting lists, term after term, into a dense numpy
array of one score a document, and only each shard's best go on to be merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm import textkernels as K
from memlake.plans.scratch import cut

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 10
IMPACT, SATURATION, LENGTH_SHARE = 1_000_000_000, 8, 75
WORK_BYTES = 1 << 19
SHARD_POSTINGS = 1 << 18
SHARD_DOCS = 1 << 15
#: A shard is a long row: readers hold a whole row group of them, and writers look at a group's size every few rows.
ROW_GROUPS = {"parquet.block.size": str(1 << 24), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
ITEMS_AT_ONCE, BYTES_AT_ONCE = 2048, 1 << 22

INDEX_SCHEMA = "doc_ids array<bigint>, terms array<string>, starts array<int>, places array<int>, impacts array<int>"


@dataclass(frozen=True)
class Totals:
    """``documents`` that hold a term, and all their ``terms`` with repeats."""

    documents: int
    terms: int


@dataclass(frozen=True)
class Block:
    """Items of one search: distinct terms with their weights, and each item's terms with repeats, as sparse rows."""

    ids: list
    terms: pa.Array
    weights: np.ndarray
    starts: np.ndarray
    slots: np.ndarray
    repeats: np.ndarray


def collection_totals(docs: DataFrame) -> Totals:
    """Counts over all rows of ``docs(text)``; a null text has no terms."""
    n = F.regexp_count("text", F.lit(TERM))
    row = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    return Totals(row["documents"], row["terms"] or 0)


def length_terms(lengths: np.ndarray, totals: Totals) -> np.ndarray:
    """Each document's ``m``: its length against the mean, in hundredths, with a fixed share."""
    scale, most = LENGTH_SHARE * totals.documents, int(lengths.max(initial=0))
    if scale * most < 1 << 63:
        return 100 - LENGTH_SHARE + lengths * scale // max(totals.terms, 1)
    return np.array([100 - LENGTH_SHARE + n * scale // max(totals.terms, 1) for n in lengths.tolist()], np.int64)


def _cut_out(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some ranges, one after the other, and their offsets."""
    size = ends - starts
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return raw[np.repeat(starts - at[:-1], size) + np.arange(at[-1])], at


class _Shard:
    """Gathers the postings of consecutive documents until they are enough for a shard."""

    def __init__(self, totals: Totals):
        self.totals = totals
        self.clear()

    def clear(self) -> None:
        self.ids, self.spelled, self.numbers, self.places, self.impacts = [], [], [], [], []
        self.docs = self.postings = self.terms = 0

    def add(self, ids: pa.Array, raw: np.ndarray, at: np.ndarray) -> None:
        """Takes in a block of documents: its (term, document) pairs with impacts, and its distinct terms.

        Words of one block (``WORK_BYTES``, or one long text) are told apart by 64 bits; blocks are put
        together, and items looked up, by the terms themselves.
        """
        words = K.Words(raw, at, blank=K.SIGNS)
        row = words.rows()
        order = np.lexsort((row, words.hashes))
        h, r = words.hashes[order], row[order]
        fresh_term = np.ones(len(h), bool)
        fresh_term[1:] = h[1:] != h[:-1]
        fresh = fresh_term.copy()
        fresh[1:] |= r[1:] != r[:-1]
        begin = np.flatnonzero(fresh)
        tf = np.diff(np.append(begin, len(h)))
        m = length_terms(np.diff(words.at), self.totals)
        place = r[begin]
        term = np.cumsum(fresh_term)[begin] - 1
        one = order[fresh_term]
        flat, offsets = _cut_out(K.LOWER[raw], words.starts[one], words.ends[one])
        self.spelled.append(pa.Array.from_buffers(pa.large_string(), len(one), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]))
        self.numbers.append(term + self.terms)
        self.places.append((place + self.docs).astype(np.int32))
        self.impacts.append((IMPACT * tf // (1000 * tf + SATURATION * m[place])).astype(np.int32))
        self.ids.append(ids)
        self.terms += len(one)
        self.docs += len(ids)
        self.postings += len(begin)

    def full(self) -> bool:
        return self.postings >= SHARD_POSTINGS or self.docs >= SHARD_DOCS

    def build(self) -> pa.RecordBatch:
        """One row of the index; posting lists lie by term, and by document within a term."""
        coded = pa.chunked_array(self.spelled).combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        number = code[np.concatenate(self.numbers)]
        places, impacts = np.concatenate(self.places), np.concatenate(self.impacts)
        order = np.lexsort((places, number))
        starts = np.zeros(len(coded.dictionary) + 1, np.int64)
        np.cumsum(np.bincount(number, minlength=len(coded.dictionary)), out=starts[1:])
        one = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a.cast(kind) if isinstance(a, pa.Array) else pa.array(a, kind))
        ids = pa.chunked_array(self.ids).combine_chunks()
        out = pa.RecordBatch.from_arrays(
            [one(ids, pa.int64()), one(coded.dictionary, pa.string()), one(starts, pa.int32()), one(places[order], pa.int32()), one(impacts[order], pa.int32())],
            ["doc_ids", "terms", "starts", "places", "impacts"],
        )
        self.clear()
        return out


def _index(batches, totals: Totals) -> Iterator[pa.RecordBatch]:
    shard = _Shard(totals)
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, raw, at in K.blocks(batch.column("text"), WORK_BYTES):
            shard.add(ids.slice(lo, hi - lo), raw, at)
            if shard.full():
                yield shard.build()
    if shard.postings:
        yield shard.build()


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of every whole text of ``docs(doc_id, text)``, one row a shard.

    doc_ids (null ones too), distinct terms, and postings: term k has ``places`` (in doc_ids) and
    ``impacts`` from ``starts[k]`` to ``starts[k + 1]``.  Texts without a term are in no posting.
    """
    totals = collection_totals(docs)
    rows = K.bounded(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").where("text is not null"))
    index = cut(rows.mapInArrow(lambda it: _index(it, totals), INDEX_SCHEMA), "lexical-index", **ROW_GROUPS)
    index.totals = totals
    return index


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats) of ``items(item_id, text)``; equal rows are one, and rows of one id one item."""
    folded = F.translate("text", UPPER, LOWER)
    terms = items.selectExpr("cast(item_id as bigint) as item_id", "text").distinct().select(
        "item_id", F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("term")
    )
    return terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


def _document_frequencies(batches, terms) -> Iterator[pa.RecordBatch]:
    wanted: pa.Array = terms.value
    total = np.zeros(len(wanted), np.int64)
    for batch in batches:
        for shard, starts in zip(batch.column("terms"), batch.column("starts")):
            slot = pc.index_in(shard.values.cast(pa.string()), value_set=wanted)
            here = np.flatnonzero(slot.is_valid().to_numpy(zero_copy_only=False))
            total[slot.take(pa.array(here)).to_numpy(zero_copy_only=False)] += np.diff(starts.values.to_numpy())[here]
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["slot", "df"])


def _block(index: DataFrame, rows: list) -> Block:
    """The items of ``rows`` with the weights of their terms, from document frequencies over all shards."""
    terms = pa.array(sorted({r["term"] for r in rows}), pa.string())
    shared = index.sparkSession.sparkContext.broadcast(terms)
    found = index.select("terms", "starts").mapInArrow(lambda it: _document_frequencies(it, shared), "slot int, df bigint")
    df = np.zeros(len(terms), np.int64)
    for r in found.groupBy("slot").agg(F.sum("df").alias("df")).collect():
        df[r["slot"]] = r["df"]
    shared.destroy()
    n = index.totals.documents
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    place = {t: k for k, t in enumerate(terms.to_pylist())}
    rows = sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["term"]))
    ids = list(dict.fromkeys(r["item_id"] for r in rows))
    of = {item: k for k, item in enumerate(ids)}
    starts = np.searchsorted([of[r["item_id"]] for r in rows], np.arange(len(ids) + 1))
    return Block(ids, terms, weights, starts, np.array([place[r["term"]] for r in rows], np.int64), np.array([r["repeats"] for r in rows], np.int64))


def best_places(scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best scores above 0, equal ones by id (missing ids last).

    argpartition alone would choose at random among those that tie with the last place; so all that
    reach its score are taken, and only then sorted and cut.
    """
    some = np.flatnonzero(scores > 0)
    if len(some) > top:
        own = scores[some]
        last = own[np.argpartition(own, len(own) - top)[len(own) - top]]
        some = some[own >= last]
    return some[np.lexsort((ids[some], missing[some], -scores[some]))[:top]]


def _search(batches, shared, top: int) -> Iterator[pa.RecordBatch]:
    block: Block = shared.value
    best: dict[int, tuple] = {}
    for batch in batches:
        for k in range(len(batch)):
            ids, terms, starts, places, impacts = (batch.column(c)[k].values for c in ("doc_ids", "terms", "starts", "places", "impacts"))
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            starts, places, impacts = starts.to_numpy(), places.to_numpy(), impacts.to_numpy()
            # where the block's terms lie in this shard, or -1
            at = pc.index_in(block.terms, value_set=terms.cast(pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
            for item in range(len(block.ids)):
                scores = np.zeros(len(ids), np.int64)
                own = slice(block.starts[item], block.starts[item + 1])
                for slot, repeats in zip(block.slots[own], block.repeats[own]):
                    if at[slot] >= 0 and block.weights[slot]:
                        a, b = starts[at[slot]], starts[at[slot] + 1]
                        scores[places[a:b]] += block.weights[slot] * repeats * impacts[a:b]
                won = best_places(scores, ids, missing, top)
                if len(won):
                    mine = scores[won], ids[won], missing[won]
                    if item in best:
                        mine = tuple(np.concatenate(x) for x in zip(best[item], mine))
                        won = best_places(*mine, top)
                        mine = tuple(x[won] for x in mine)
                    best[item] = mine
    if best:
        scores, ids, missing = (np.concatenate(x) for x in zip(*best.values()))
        items = [block.ids[k] for k, (s, _, _) in best.items() for _ in range(len(s))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(ids, pa.int64(), mask=missing), pa.array(scores)], ["item_id", "doc_id", "score"]
        )


def search_index(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0, the best first.

    ``index`` comes from :func:`build_index`.  Items are a stated query set: they are read in blocks of
    about ``ITEMS_AT_ONCE`` items and ``BYTES_AT_ONCE`` bytes of terms, each broadcast and gone through on
    its own, so what is broadcast does not grow with either table.  A task keeps ``top`` documents an item,
    whatever the number of its shards; the merge ranks those again.

    Equal scores are ordered by doc_id, null ones last; every row of the documents is ranked, so repeated
    doc_ids can come twice.  Null texts and texts without terms are never found, items without terms have
    no rows, and a null item_id is an item of its own.
    """
    spark = index.sparkSession
    wanted = cut(item_terms(items), "item-terms")
    size = wanted.agg(F.countDistinct("item_id").alias("n"), F.sum(F.octet_length("term") + 16).alias("bytes")).first()
    blocks = max(-(-size["n"] // ITEMS_AT_ONCE), -(-(size["bytes"] or 0) // BYTES_AT_ONCE), 1)
    found = None
    for k in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(_block(index, rows))
        part = index.mapInArrow(lambda it, shared=shared: _search(it, shared, top), "item_id bigint, doc_id bigint, score bigint")
        part = cut(part, "lexical-part")
        shared.destroy()
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index ``docs(doc_id, text)`` and rank all of them for each of ``items(item_id, text)``."""
    return search_index(build_index(docs), items, top)
