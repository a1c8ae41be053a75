"""N-gram Jaccard join by multiple-global-order prefix filtering.

Two shingle sets with Jaccard >= t share at least k tokens among the first ``n - ceil(t n) + k`` of each
set under *any* global token order (k = 1 is the usual prefix; sets of fewer tokens share what they have).  The first order puts tokens rarest first, by counts over the whole
corpus folded into a fixed number of hash buckets, and generates candidates; further orders, by
independent hashes, each have to confirm a candidate before the two whole sets are compared.

Hot groups: exact copies are one class from the start.  Within a bucket of texts that share a prefix
token, pairs are not enumerated: each text is compared with a leader, components are formed, and
only pairs that still lie in different components are looked at again, so a group of thousands of
near copies costs about one comparison each while no link between different components is lost.
Of buckets with the same texts one is kept.  What is looked at again is dealt out by pairs of runs of
at most about ``RUN`` texts, so no task holds a whole bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm import textkernels as K
from memlake.llm.components import extend_components
from memlake.plans.scratch import BROADCAST_ROWS, broadcast_if_small, counted, cut, discard, join_hot, numbered, rows_of

SHINGLE = 5
PERCENT = 80
BUCKET_BITS = 18
ORDER_SEEDS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)
SHARED = 4
STAR_ROUNDS = 2
RUN = 1000
FILTER_BITS = 20
COARSE, FINE = 1024, 4096
_ORDERS = [f"order{i}" for i in range(len(ORDER_SEEDS))]


def prefix_size(n: int, percent: int, shared: int = 1) -> int:
    """How many first tokens of a set of ``n`` hold ``shared`` tokens of any partner's first tokens."""
    return min(n, n + (-n * percent // 100) + shared)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> K.U64(64 - BUCKET_BITS)).view(np.int64)


def _count_buckets(batches, size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for _, _, raw, at in K.blocks(batch.column("text")):
            sets = list(K.shingle_rows(K.Words(raw, at), size))
            total += np.bincount(_bucket(np.concatenate(sets)), minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])


def token_counts(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """In how many texts the shingles of each hash bucket occur; 2 MB whatever the corpus."""
    rows = (
        docs.select("text")
        .mapInArrow(lambda it: _count_buckets(it, size), "bucket int, n bigint")
        .groupBy("bucket").agg(F.sum("n").alias("n"))
    )
    return K.gathered(rows, 1 << BUCKET_BITS, np.int64)


def _rarest(tokens: np.ndarray, counts: np.ndarray, keep: int) -> np.ndarray:
    """The first ``keep`` tokens in the order of (bucket count, hash)."""
    rank = np.minimum(counts[_bucket(tokens)], (1 << 24) - 1).astype(K.U64) << K.U64(40)
    rank |= tokens & K.U64((1 << 40) - 1)
    return tokens[np.argsort(rank, kind="stable")[:keep]]


def _by_hash(tokens: np.ndarray, seed: int, keep: int) -> np.ndarray:
    """The first ``keep`` tokens under a hash order, as 32-bit fingerprints of that order's keys.

    Equal tokens have equal fingerprints, so a filter on them never loses a pair.
    """
    keys = K.mix(tokens ^ K.U64(seed))
    keys.sort()
    return (keys[:keep] >> K.U64(32)).astype(np.uint32).view(np.int32)


def _prefixes(batches, counts, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    table = counts.value
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, raw, at in K.blocks(batch.column("text")):
            words = K.Words(raw, at)
            h1, h2 = K.sequence_keys(words)
            sets = list(K.shingle_rows(words, size))
            heads = [K.signed(_rarest(s, table, prefix_size(len(s), percent, SHARED) if len(s) else 0)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(K.signed(h1)), pa.array(K.signed(h2)), K.lists(heads, pa.int64())],
                ["doc_id", "n_shingles", "h1", "h2", "prefix"],
            )


def _facts(batches, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """What the filters need of a text: set size, parity bitmaps, and its prefix under further orders."""
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, raw, at in K.blocks(batch.column("text")):
            sets = list(K.shingle_rows(K.Words(raw, at), size))
            keep = [prefix_size(len(s), percent) if len(s) else 0 for s in sets]
            bits, fine = [], []
            for s in sets:
                odd = (np.bincount((s & K.U64(FINE - 1)).view(np.int64), minlength=FINE) & 1).astype(np.uint8)
                fine.append(np.packbits(odd).view(np.int64))
                bits.append(np.packbits(np.bitwise_xor.reduce(odd.reshape(FINE // COARSE, COARSE), axis=0)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), K.lists(bits, pa.int64()), K.lists(fine, pa.int64()),
                 *(K.lists([_by_hash(s, seed, k) for s, k in zip(sets, keep)], pa.int32()) for seed in ORDER_SEEDS)],
                ["node", "n", "parity", "fine", *_ORDERS],
            )


def _sets(batches, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, raw, at in K.blocks(batch.column("text")):
            sets = [K.signed(s) for s in K.shingle_rows(K.Words(raw, at), size)]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), K.lists(sets, pa.int64())], ["node", "tokens"])


def _possibly_shared(batches, bits) -> Iterator[pa.RecordBatch]:
    """(token, node, need) of the prefix tokens whose bit is set."""
    table = bits.value
    for batch in batches:
        prefix = batch.column("prefix")
        tokens = prefix.flatten().to_numpy(zero_copy_only=False)
        node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), prefix.value_lengths().to_numpy(zero_copy_only=False))
        word, bit = _bit_place(tokens.view(K.U64))
        some = (table[word] >> bit) & K.U64(1) == 1
        need = np.repeat(batch.column("need").to_numpy(zero_copy_only=False), prefix.value_lengths().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(tokens[some]), pa.array(node[some]), pa.array(need[some])], ["token", "node", "need"])


def _bit_place(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (tokens >> K.U64(64 - FILTER_BITS)).view(np.int64), (tokens >> K.U64(58 - FILTER_BITS)) & K.U64(63)


def shared_token_bits(shared: DataFrame) -> np.ndarray:
    """A bit for each token of ``shared``, by its hash; 8 MB whatever the number of tokens.

    It keeps tokens that one text alone has out of the shuffle; the join after it is exact.
    """
    place = F.shiftrightunsigned("token", 64 - FILTER_BITS).cast("int")
    bit = F.shiftrightunsigned("token", 58 - FILTER_BITS).bitwiseAND(F.lit(63)).cast("int")
    rows = shared.groupBy(place.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"))
    return K.gathered(rows, 1 << FILTER_BITS, K.U64)


_FACTS_SCHEMA = "node bigint, n bigint, parity array<bigint>, fine array<bigint>, " + ", ".join(f"{o} array<int>" for o in _ORDERS)


def _near(apart: Column, percent: int) -> Column:
    """Tokens in one set only number at least the bits in which the parity bitmaps differ, and at
    Jaccard t at most (1-t)/(1+t) of both sizes together."""
    return apart * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent)


def _may_match(percent: int) -> Column:
    """Bounds that every linked pair meets: sizes and coarse parity bitmaps."""
    apart = sum((F.bit_count(F.col("a.parity")[i].bitwiseXOR(F.col("b.parity")[i])) for i in range(COARSE // 64)), F.lit(0))
    sized = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    return sized & _near(apart, percent)


def _only(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """``rows`` of nodes on one side of ``pairs``, picked before the shuffle while the pairs are few."""
    if rows_of(pairs) > BROADCAST_ROWS:
        return rows
    return rows.join(F.broadcast(pairs.select(F.col(side).alias("node"))), "node", "left_semi")


def _passing(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) that meet the bounds and share prefix tokens under every further order."""
    agree = F.lit(True)
    for order in _ORDERS:
        agree = agree & F.arrays_overlap(f"a.{order}", f"b.{order}")

    def facing(some: DataFrame, *columns: str) -> DataFrame:
        one, two = (_only(facts.select("node", *columns), some, side) for side in ("a", "b"))
        return (
            some.alias("p").join(one.alias("a"), F.col("p.a") == F.col("a.node")).join(two.alias("b"), F.col("p.b") == F.col("b.node"))
        )

    # each step carries more bytes of a text than the one before, for fewer pairs
    near = counted(facing(pairs, "n", "parity").where(_may_match(percent)).select("p.a", "p.b").distinct(), "near")
    bits = F.zip_with("a.fine", "b.fine", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda total, x: total + x)
    nearer = counted(facing(near, "n", "fine").where(_near(apart, percent)).select("p.a", "p.b").distinct(), "nearer")
    discard(near)
    return facing(nearer, *_ORDERS).where(agree).select("p.a", "p.b").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b): those whose whole sets link."""
    both = F.size(F.array_intersect("x.tokens", "y.tokens")).cast("bigint")
    either = F.size("x.tokens") + F.size("y.tokens") - both
    return (
        pairs.join(_only(sets, pairs, "a").alias("x"), F.col("a") == F.col("x.node"))
        .join(_only(sets, pairs, "b").alias("y"), F.col("b") == F.col("y.node"))
        .where(both * 100 >= either * percent)
        .select("a", "b").distinct()
    )


def _distinct_buckets(members: DataFrame) -> DataFrame:
    """``members`` (token, node, met) with one token for each distinct set of two or more nodes.

    Near copies share many tokens, whose buckets hold the same nodes and so offer the same pairs.
    Buckets are told apart by their size and two 40-bit sums over hashes of their nodes; a bucket too
    large for the sums stays on its own.
    """
    h = F.xxhash64("node")
    sums = [F.coalesce(F.try_sum(part), "token") for part in (F.shiftrightunsigned(h, 24), h.bitwiseAND(F.lit((1 << 40) - 1)))]
    buckets = members.groupBy("token").agg(F.count(F.lit(1)).alias("n"), sums[0].alias("s1"), sums[1].alias("s2"))
    kept = counted(buckets.where("n > 1").groupBy("n", "s1", "s2").agg(F.min("token").alias("token")).select("token"), "buckets")
    out = cut(members.join(broadcast_if_small(kept), "token"), "members")
    discard(members, kept)
    return out


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles and component_id.

    Texts link when ``100 * |A & B| >= percent * |A | B|`` over their sets of ``size``-word shingles;
    component_id is the smallest doc_id reachable by links, the row's own included.

    Defined cases: a null or wordless text has no shingles and links with nothing; a text of fewer
    than ``size`` words has one shingle, its whole sequence; repeated rows and equal texts share a
    class; rows of one doc_id count as the same document; a row without doc_id takes the component
    of its class, null if no such row has an id.  Columns beyond doc_id and text are ignored.
    """
    spark = docs.sparkSession
    docs = K.bounded(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    counts = spark.sparkContext.broadcast(token_counts(docs, size))
    rows = cut(
        docs.mapInArrow(
            lambda it: _prefixes(it, counts, size, percent),
            "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, prefix array<bigint>",
        ),
        "prefixes",
    )
    some = rows.where("n_shingles > 0")
    copies = counted(
        some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1").select("h1", "h2", "rep"),
        "copies",
    )
    firsts = (
        some.join(broadcast_if_small(copies), ["h1", "h2"], "left")
        .where("doc_id is not null and (rep is null or rep = doc_id)")
    )
    # a partner shares SHARED prefix tokens, or all that a small set must have in common with it
    need = F.least(F.lit(SHARED), F.ceil(F.col("n_shingles") * percent / 100.0)).cast("int").alias("need")
    heads = firsts.select(F.col("doc_id").alias("node"), "prefix", need)
    shared = cut(
        heads.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("token"),
        "shared",
    )
    bits = spark.sparkContext.broadcast(shared_token_bits(shared))
    met = heads.mapInArrow(lambda it: _possibly_shared(it, bits), "token bigint, node bigint, need int")
    every = cut(met.join(shared, "token"), "members")
    nodes = counted(
        every.groupBy("node").agg(F.count(F.lit(1)).alias("met"), F.min("need").alias("need")).where("met >= need").select("node", "met"),
        "nodes",
    )

    def texts_of(wanted: DataFrame) -> DataFrame:
        return docs.join(broadcast_if_small(wanted.select(F.col("node").alias("doc_id")), rows=rows_of(wanted)), "doc_id", "left_semi")

    facts = counted(texts_of(nodes).mapInArrow(lambda it: _facts(it, size, percent), _FACTS_SCHEMA), "facts")
    repeated = rows_of(facts) > rows_of(nodes)  # each node has a row at least
    if repeated:
        facts = cut(facts.dropDuplicates(), "facts")
    members = _distinct_buckets(cut(every.select("token", "node").join(broadcast_if_small(nodes), "node"), "members"))
    discard(every, shared)
    sets = None

    tried, labels, scrap = None, None, []
    for turn in range(STAR_ROUNDS + 1):
        placed = _labelled(members, labels)
        # first the texts that meet others in most of their prefix, then any, by a fresh hash
        rank = F.struct("met", "node", "label") if not turn else F.struct(F.xxhash64("node", F.lit(turn)), "node", "label")
        leaders = counted(
            placed.groupBy("token")
            .agg(F.max(rank).alias("top"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
            .where("lo < hi").select("token", "top.node", "top.label", "size"),
            "leaders",
        )
        scrap.append(leaders)
        if turn < STAR_ROUNDS:
            met = (
                join_hot(placed, leaders.selectExpr("token", "node as lead", "label as lead_label"), ["token"], rows=rows_of(leaders))
                .where("label <> lead_label").select("node", "lead")
            )
            met = met.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
        else:
            met = _all_across(join_hot(placed, leaders.select("token", "size"), ["token"], rows=rows_of(leaders)), facts, percent)
        met = met.distinct()
        if tried is not None:
            met = met.join(tried, ["a", "b"], "left_anti")
        met = counted(met, "pairs")
        if not rows_of(met):
            if turn < STAR_ROUNDS and not rows_of(leaders):
                break
            continue
        scrap.append(met)
        tried = met if tried is None else tried.union(met)
        passed = counted(_passing(met, facts, percent), "passed")
        if not rows_of(passed):
            continue
        wanted = passed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if sets is not None:
            wanted = wanted.join(sets.select("node"), "node", "left_anti")
        fresh = texts_of(counted(wanted, "wanted")).mapInArrow(lambda it: _sets(it, size), "node bigint, tokens array<bigint>")
        fresh = cut(fresh.dropDuplicates() if repeated else fresh, "sets")
        scrap.append(fresh)
        sets = fresh if sets is None else sets.union(fresh)
        found = counted(_linked(passed, sets, percent), "links")
        if not rows_of(found):
            continue
        labels = extend_components(labels, found)

    classes = some.select("h1", "h2", "doc_id").join(broadcast_if_small(copies), ["h1", "h2"], "left")
    named = copies.select("h1", "h2", F.col("rep").alias("node"))
    if labels is not None:
        alone = (
            classes.where("rep is null and doc_id is not null")
            .select("h1", "h2", F.col("doc_id").alias("node"))
            .join(labels.select("node"), "node", "left_semi")
        )
        named = _labelled(named.unionByName(alone), labels)
    else:
        named = named.withColumn("label", F.col("node"))
    named = counted(
        named.groupBy("h1", "h2").agg(F.min("label").alias("component_id"), F.lit(True).alias("named")), "classes"
    )
    discard(facts, members, nodes, *scrap)
    narrow = rows.select("doc_id", "n_shingles", "h1", "h2")
    return narrow.join(broadcast_if_small(named), ["h1", "h2"], "left").select(
        "doc_id", "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("named"), F.col("component_id"))
        .otherwise(F.col("doc_id")).alias("component_id"),
    )


def _all_across(members: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Every pair that shares a token and still lies in two components, within the bounds.

    ``members``: token, node, label and the bucket's size.  A bucket is cut into runs of about ``RUN``
    texts by a hash, and each pair of runs (lo, hi) is a join key of its own.
    """
    runs = F.ceil(F.col("size") / RUN)
    rows = (
        members.join(facts.select("node", "n", "parity"), "node")
        .withColumn("run", F.pmod(F.xxhash64("node", F.lit(RUN)), runs))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), runs - 1)))
        .select("token", "node", "label", "n", "parity", "run", F.least("run", "other").alias("lo"), F.greatest("run", "other").alias("hi"))
    )
    near = (F.col("a.token") == F.col("b.token")) & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi"))
    # two texts of one run meet under that run alone
    once = (F.col("a.run") != F.col("b.run")) | (F.col("a.lo") == F.col("a.hi"))
    return (
        rows.alias("a")
        .join(rows.alias("b"), near & once & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label")) & _may_match(percent))
        .select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    )


def near_duplicate_keepers(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of linked rows; all columns are kept.

    Groups are of rows, not of ids: rows of one doc_id with unlike texts are apart, and rows without
    doc_id are rows like any other.  Of a group the row with the least doc_id stays (rows without
    one come last), of several such the first written.  A null or wordless text links with nothing and stays.
    """
    rows, key = numbered(docs)
    placed = jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"), size, percent)
    grouped = placed.where("n_shingles > 0").select(F.col("doc_id").alias(key), F.col("component_id").alias("group"))
    several = counted(grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group"), "groups")
    crowd = cut(join_hot(grouped, several, ["group"]), "crowd")
    ids = rows.select(F.col(key), F.col("doc_id").alias("own"))
    rank = F.struct(F.col("own").isNull().alias("last"), "own", key)
    best = crowd.join(ids, key).groupBy("group").agg(F.min(rank).alias("best")).select("group", F.col(f"best.{key}").alias("best"))
    gone = counted(join_hot(crowd, counted(best, "best"), ["group"]).where(F.col(key) != F.col("best")).select(key), "gone")
    discard(several, crowd)
    return rows.join(broadcast_if_small(gone), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
