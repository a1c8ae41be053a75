"""Benchmark decontamination by latent semantic retrieval.

All benchmark passages become TF-IDF rows (inverse document frequencies over the whole corpus).  A
distributed randomised SVD finds their latent space: every task sketches its passages by random signs into
``SKETCH`` places and adds up one Gram matrix, the matrices are summed in a tree, and the leading
``RANK`` eigenvectors of the sum span the space, whatever the number of passages.  Every window of every text
is folded in and compared by cosine with the passages; candidates are settled by the longest common
subsequence of words and by whether the item's answer is there, so reworded copies are caught as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import textkernels as K
from memlake.plans.scratch import broadcast_if_small, counted, cut, numbered

FEATURE_BITS = 18
STEP = 16
SKETCH, RANK = 1024, 192
SUMS_AT_ONCE = 8
COSINE, LATENT = 0.3, 0.42
EXACT, REWORDED, ANSWER = 0.8, 0.5, 0.6
ITEMS_AT_ONCE, BYTES_AT_ONCE = 4096, 1 << 23


@dataclass(frozen=True)
class Space:
    """The latent space: idf and whether the benchmark has it, by feature, and the basis by place of the sketch."""

    idf: np.ndarray
    known: np.ndarray
    basis: np.ndarray


@dataclass(frozen=True)
class Passages:
    """Passages of two ``step``s as unit rows: the directions of their latent vectors, and the lengths of the parts
    of each row ``inside`` the space and outside of it (``rest``).

    ``most``: the largest weight that any of the passages gives to each feature.
    """

    step: int
    vectors: np.ndarray
    inside: np.ndarray
    rest: np.ndarray
    owners: np.ndarray
    most: np.ndarray


@dataclass(frozen=True)
class Block:
    """Some items, their words, and their passages by step."""

    ids: np.ndarray
    words: list[np.ndarray]
    passages: list[Passages]


def _features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> K.U64(64 - FEATURE_BITS)).view(np.int64)


def _doc_counts(batches) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << FEATURE_BITS) + 1, np.int64)
    for batch in batches:
        for lo, hi, raw, at in K.blocks(batch.column("text")):
            words = K.Words(raw, at)
            pairs = words.rows() << FEATURE_BITS | _features(words.hashes)
            pairs.sort()
            first = np.ones(len(pairs), bool)
            first[1:] = pairs[1:] != pairs[:-1]
            total[:-1] += np.bincount(pairs[first] & ((1 << FEATURE_BITS) - 1), minlength=1 << FEATURE_BITS)
            total[-1] += hi - lo
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["feature", "n"])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Texts of ``docs`` per hashed word, and the number of them (2 MB, fixed).

    Every row counts, copies too: telling them apart would move all texts through a shuffle, and copies
    only make the words of hot texts a little lighter.
    """
    rows = (
        K.bounded(docs.select("text").where("text is not null")).mapInArrow(_doc_counts, "feature int, n bigint")
        .groupBy("feature").agg(F.sum("n").alias("n"))
    )
    out = K.gathered(rows, (1 << FEATURE_BITS) + 1, np.int64)
    return out[:-1], int(out[-1])


def _step(size: int) -> int:
    """The step for an item of so many words: a window is not much longer than the item, so it is not drowned."""
    step = STEP
    while step > 1 and 3 * step > 2 * size:
        step //= 2
    return step


def _passages(words: np.ndarray, step: int) -> list[np.ndarray]:
    """The windows of two steps of an item's words."""
    return [words[at : at + 2 * step] for at in range(0, max(1, len(words) - step), step)]


def _places(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of each feature in the sketch, by a hash."""
    mixed = K.mix(features.astype(K.U64) + K.U64(0x5851F42D4C957F2D))
    return (mixed % K.U64(SKETCH)).astype(np.int64), np.where(mixed >> K.U64(63), 1.0, -1.0)


def _flat(passages: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight) of the TF-IDF rows of unit length, one entry for each feature of a row."""
    row = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    pairs, times = np.unique(row << FEATURE_BITS | _features(np.concatenate(passages)), return_counts=True)
    row, feature = pairs >> FEATURE_BITS, pairs & ((1 << FEATURE_BITS) - 1)
    weight = times * idf[feature]
    return row, feature, weight / np.sqrt(np.bincount(row, weight * weight, len(passages)))[row]


def _sketched(row: np.ndarray, feature: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    place, sign = _places(feature)
    return np.bincount(row * SKETCH + place, weight * sign, rows * SKETCH).reshape(rows, SKETCH)


def _item_words(texts: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, raw, at in K.blocks(texts):
        words = K.Words(raw, at)
        out += [words.hashes[a:b] for a, b in zip(words.at, words.at[1:])]
    return out


def _grams(batches, idf) -> Iterator[pa.RecordBatch]:
    """One Gram matrix of all sketched passages of a task, and the features they have."""
    gram, known = np.zeros((SKETCH, SKETCH)), np.zeros(1 << FEATURE_BITS, bool)
    for batch in batches:
        passages = [p for words in _item_words(batch.column("text")) if len(words) for p in _passages(words, _step(len(words)))]
        for lo in range(0, len(passages), 1024):
            row, feature, weight = _flat(passages[lo : lo + 1024], idf.value)
            known[feature] = True
            rows = _sketched(row, feature, weight, len(passages[lo : lo + 1024]))
            gram += rows.T @ rows
    yield _packed(gram, known)


def _packed(gram: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([np.packbits(known).tobytes()], pa.binary())], ["gram", "known"])


def _total(batches) -> tuple[np.ndarray, np.ndarray]:
    gram, known = np.zeros((SKETCH, SKETCH)), np.zeros(1 << FEATURE_BITS, bool)
    for batch in batches:
        for g, k in zip(batch.column("gram"), batch.column("known")):
            gram += np.frombuffer(g.as_buffer(), float).reshape(SKETCH, SKETCH)
            known |= np.unpackbits(np.frombuffer(k.as_buffer(), np.uint8)).astype(bool)
    return gram, known


def _leading(batches, rank: int) -> Iterator[pa.RecordBatch]:
    """The leading eigenvectors of the whole sum, in one task over ``SUMS_AT_ONCE`` matrices of fixed size."""
    gram, known = _total(batches)
    values, vectors = np.linalg.eigh(gram)
    some = values > 1e-9 * max(values.max(initial=0), 1e-30)
    yield _packed(vectors[:, some][:, -rank:].astype(np.float32), known)


def latent_space(items: DataFrame, idf: np.ndarray, rank: int = RANK) -> Space:
    """The latent space of all passages of ``items(text)``, by a distributed randomised SVD.

    The Gram matrix of the sketched rows has their right singular vectors; what tasks hand on is one
    matrix of fixed size each, and the driver gets the basis alone.
    """
    schema = "gram binary, known binary"
    shared = items.sparkSession.sparkContext.broadcast(idf)
    parts = items.select("text").mapInArrow(lambda it: _grams(it, shared), schema).repartition(SUMS_AT_ONCE)
    whole = parts.mapInArrow(lambda it: [_packed(*_total(it))], schema).repartition(1).mapInArrow(lambda it: _leading(it, rank), schema)
    row = whole.first()
    shared.destroy()
    known = np.unpackbits(np.frombuffer(row["known"], np.uint8)).astype(bool)
    return Space(idf, known, np.frombuffer(row["gram"], np.float32).reshape(SKETCH, -1))


def place_items(space: Space, ids: np.ndarray, words: list[np.ndarray]) -> Block:
    """A block of items with the latent vectors of their passages."""
    by_step: dict[int, list] = {}
    for i, w in enumerate(words):
        by_step.setdefault(_step(len(w)), []).extend((i, p) for p in _passages(w, _step(len(w))))
    out = []
    for step, own in sorted(by_step.items()):
        row, feature, weight = _flat([p for _, p in own], space.idf)
        most = np.zeros(1 << FEATURE_BITS, np.float32)
        np.maximum.at(most, feature, weight.astype(np.float32))
        vectors = np.empty((len(own), space.basis.shape[1]), np.float32)
        for lo in range(0, len(own), 256):
            hi = min(lo + 256, len(own))
            a, b = np.searchsorted(row, [lo, hi])
            vectors[lo:hi] = _sketched(row[a:b] - lo, feature[a:b], weight[a:b], hi - lo) @ space.basis
        inside = np.linalg.norm(vectors, axis=1)
        vectors /= np.maximum(inside, 1e-9)[:, None]
        out.append(Passages(step, vectors, inside, np.sqrt(np.maximum(0, 1 - inside * inside)), np.array([i for i, _ in own]), most))
    return Block(ids, words, out)


def common_subsequence(places: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence; ``places``: word to the bits of its places."""
    every = (1 << size) - 1
    row = every
    for word in words:
        seen = row & places.get(word, 0)
        row = ((row + seen) | (row - seen)) & every
    return size - row.bit_count()


class _Item:
    """What the checks of one item need: its words' places, and the answer's words.

    The answer is the rarer half of the words in the item's last third.
    """

    def __init__(self, words: np.ndarray, idf: np.ndarray):
        self.words, self.size = words, len(words)
        self.places: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            self.places[w] = self.places.get(w, 0) | 1 << i
        self.counts = {w: bits.bit_count() for w, bits in self.places.items()}
        tail = np.unique(words[-max(1, len(words) // 3) :])
        rare = idf[_features(tail)]
        self.answer = set(tail[np.argsort(-rare, kind="stable")[: -(-len(tail) // 2)]].tolist())


class _Steps:
    """The steps of a block of texts: runs of words within a row; a window is a step and the next of its row."""

    def __init__(self, words: K.Words, scale: np.ndarray, step: int):
        row = words.rows()
        opens = (np.arange(len(row)) - words.at[row]) % step == 0
        self.begins = np.flatnonzero(opens)
        self.of = np.cumsum(opens) - 1
        self.row = row[self.begins]
        self.follows = np.append(self.row[1:] == self.row[:-1], False)
        self.full = self.windows(np.add.reduceat(scale * scale, self.begins))

    def windows(self, steps: np.ndarray) -> np.ndarray:
        out = steps.copy()
        out[self.follows] += steps[1:][self.follows[:-1]]
        return out


def _near(space: Space, group: Passages, features: np.ndarray, scale: np.ndarray, steps: _Steps) -> Iterator[tuple]:
    """(windows, passages, cosines) of the windows and passages that may have a cosine of ``COSINE`` and have a
    latent cosine of ``LATENT`` or more.

    A product of two rows is that of their latent vectors and that of what lies outside the space, which is
    no more than the product of those two lengths: pairs whose sum stays under ``COSINE`` are passed over.
    """
    held = np.flatnonzero(space.known[features])
    own = steps.of[held]
    # words that no passage has add nothing: those windows are too far from all passages
    joint = steps.windows(np.bincount(own, scale[held] ** 2, len(steps.begins)))
    # nor can a product be more than each word at the largest weight it has in any passage
    product = steps.windows(np.bincount(own, scale[held] * group.most[features[held]], len(steps.begins)))
    window = np.flatnonzero((joint >= COSINE * COSINE * steps.full) & (product >= 0.999 * COSINE * np.sqrt(steps.full)))
    for a in range(0, len(window), 256):
        some = window[a : a + 256]
        nxt = steps.follows[some]
        need = np.unique(np.append(some, some[nxt] + 1))
        lo, hi = np.searchsorted(own, [need[0], need[-1] + 1])
        slot = np.searchsorted(need, own[lo:hi])
        use = need[slot] == own[lo:hi]
        slot, token = slot[use], held[lo:hi][use]
        cuts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        place, sign = _places(features[token])
        folded = np.zeros((len(need), space.basis.shape[1]), np.float32)
        folded[slot[cuts]] = np.add.reduceat(space.basis[place] * (scale[token] * sign).astype(np.float32)[:, None], cuts, axis=0)
        vector = folded[np.searchsorted(need, some)]
        vector[nxt] += folded[np.searchsorted(need, some[nxt] + 1)]
        length = np.linalg.norm(vector, axis=1)
        vector /= np.maximum(length, 1e-9)[:, None]
        latent = vector @ group.vectors.T
        w, k = np.nonzero(latent >= LATENT)
        cosine = latent[w, k]
        outside = np.sqrt(np.maximum(0, joint[some] - length * length))
        most = cosine * length[w] * group.inside[k] + outside[w] * group.rest[k]
        may = most >= COSINE * np.sqrt(steps.full[some])[w]
        yield some[w[may]], k[may], cosine[may]


def _search(batches, space: Broadcast, block: Broadcast) -> Iterator[pa.RecordBatch]:
    latent, model = space.value, block.value
    checks = [_Item(w, latent.idf) for w in model.words]
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, _, raw, at in K.blocks(batch.column("text")):
            words = K.Words(raw, at)
            if not len(words.hashes):
                continue
            features = _features(words.hashes)
            scale = latent.idf[features]
            found: dict = {}
            for group in model.passages:
                steps = _Steps(words, scale, group.step)
                for windows, passages, cosines in _near(latent, group, features, scale, steps):
                    hits = zip(steps.row[windows].tolist(), group.owners[passages].tolist(), cosines.tolist(), steps.begins[windows].tolist())
                    for row, item, cosine, start in hits:
                        found.setdefault((row, item), []).append((cosine, start, start + 2 * group.step))
            out = _settle(found, words, checks)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(at) - 1).take(pa.array([o[0] for o in out])), pa.array(model.ids[[o[1] for o in out]]),
                     *(pa.array([o[k] for o in out], pa.float64()) for k in (2, 3, 4))],
                    ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"],
                )


def _settle(found: dict, words: K.Words, checks: list[_Item]) -> list[tuple]:
    """(row, item, cosine, lcs share, answer share) of the candidates that hold.

    Each candidate window is widened by the item's own length on both sides, within its row.
    """
    out = []
    for (row, item), windows in found.items():
        check = checks[item]
        best = None
        seen = set()
        for cosine, start, end in sorted(windows, reverse=True):
            a = max(int(words.at[row]), start - check.size)
            b = min(int(words.at[row + 1]), end + check.size)
            if (a, b) in seen:
                continue
            seen.add((a, b))
            region = words.hashes[a:b].tolist()
            # a common subsequence is no longer than the item's words that the region has
            if sum(map(check.counts.__getitem__, check.counts.keys() & region)) < REWORDED * check.size:
                continue
            lcs = common_subsequence(check.places, check.size, region) / check.size
            answer = len(check.answer.intersection(region)) / len(check.answer)
            if lcs >= EXACT or lcs >= REWORDED and answer >= ANSWER:
                mine = (lcs, answer, cosine)
                best = mine if best is None else max(best, mine)
                if lcs == answer == 1:
                    break
        if best:
            out.append((row, item, best[2], best[0], best[1]))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share): texts that hold a benchmark item.

    A pair is returned if the longest common subsequence covers at least ``EXACT`` of the item's
    words, or at least ``REWORDED`` with ``ANSWER`` of the answer's words present; one row for each
    (doc_id, item_id), with the best values (the cosine is that of the latent vectors).  Null and empty texts
    hold nothing; benchmark rows without id or words are not looked for; rows without doc_id come out as
    one document.

    The items are a stated query set.  They are gone through in blocks of about ``ITEMS_AT_ONCE`` items and
    ``BYTES_AT_ONCE`` bytes, one after the other: a block is broadcast, its part of the result written, and the
    broadcast ended, so driver and executors hold one block whatever the size of the benchmark.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    schema = "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_share double"
    items = cut(benchmark.selectExpr("cast(item_id as bigint) as item_id", "text").where("item_id is not null and text is not null").distinct(), "items")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    found = spark.createDataFrame([], schema)
    if not size["n"]:
        return found
    counts, texts = document_frequencies(docs)
    # no word is without weight, however common: an item may consist of such words
    space = sc.broadcast(latent_space(items, 1 + np.log((texts + 1) / (counts + 1))))
    blocks = max(-(-size["n"] // ITEMS_AT_ONCE), -(-size["bytes"] // BYTES_AT_ONCE), 1)
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted(some.collect(), key=lambda r: (r["item_id"], r["text"]))
        words = _item_words(pa.array([r["text"] for r in rows], pa.string()))
        kept = [i for i, w in enumerate(words) if len(w)]
        if not kept:
            continue
        block = sc.broadcast(place_items(space.value, np.array([rows[i]["item_id"] for i in kept]), [words[i] for i in kept]))
        part = K.bounded(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")).mapInArrow(
            lambda it, block=block: _search(it, space, block), schema
        )
        found = found.union(cut(part, "leaks"))
        block.destroy()
    space.destroy()
    best = F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.cosine", "m.lcs_share", "m.answer_share")


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns are kept.

    Rows are judged one by one, so a null or repeated doc_id neither saves nor condemns a row.
    """
    rows, key = numbered(docs)
    leaks = counted(find_leaks(rows.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return rows.join(broadcast_if_small(leaks), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
