"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Leaf *i* of a piece's tree holds the rank of the pair that starts at live byte position *i* (together
with *i*, so that ties go left), an inner node the least of its two children.  A merge reads the root,
joins two neighbours and renews three leaves: the pair merged away, the pair that now starts there,
and the pair of the live neighbour before it; each is a logarithmic point update.  All distinct
uncached pieces of a block go through these steps side by side as numpy rows; a piece longer than
``WIDE`` bytes runs its own tree, so one giant word costs n log n, not n squared.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memlake.llm import textkernels as K

NONE = np.int64(1) << 62
PLACE = (1 << 32) - 1
WIDE = 1 << 11
ROWS_WIDTH = 1 << 16
CACHE_PIECES = 60_000
SPACE, LETTER, NUMBER, OTHER = range(4)


class Vocabulary:
    """Token bytes by rank, and the rank of each mergeable pair of tokens.

    A pair is mergeable when its joined bytes are a token, whichever way that token was built.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        found = {}
        for joined, rank in self.rank.items():
            for cut in range(1, len(joined)):
                left, right = self.rank.get(joined[:cut]), self.rank.get(joined[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        keys = np.fromiter(found.keys(), np.int64, len(found))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], NONE)
        self.pair_ranks = np.append(np.fromiter(found.values(), np.int64, len(found))[order], 0)
        self.bytes_rank = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        grid = np.arange(256)
        self.bytes_pair = self.pair(self.bytes_rank[grid[:, None]], self.bytes_rank[grid]).ravel()

    @cached_property
    def known(self) -> dict[int, int]:
        """The pairs' ranks by key, for single lookups."""
        return dict(zip(self.pair_keys[:-1].tolist(), self.pair_ranks[:-1].tolist()))

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where its joined bytes are no token."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)


def load_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(rows)
    for token, rank in rows:
        out[int(rank)] = base64.b64decode(token)
    return out


@cache
def code_point_classes() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER for every code point."""
    import regex

    points = np.arange(0x110000, dtype=np.uint32)
    every = points[(points < 0xD800) | (points >= 0xE000)].tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def _code_points(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a block, the byte place of each (n+1), and the row offsets in code points."""
    if not len(raw) or raw.max() < 128:
        return raw.astype(np.uint32), np.arange(len(raw) + 1), at
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.append(lead, len(raw)), np.searchsorted(lead, at)


def split_pieces(raw: np.ndarray, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Pieces of every row by the public split pattern, and the rows' offsets among them.

    The pattern takes, at each place: a contraction ('s 't 're 've 'm 'll 'd); an optional blank and a
    run of letters, of numbers, or of other signs; white space up to its last character if a word
    follows, else all of it; a last white space character on its own.
    """
    points, place, rows = _code_points(raw, at)
    n = len(points)
    kind = code_point_classes()[points]
    opens = np.zeros(n + 1, bool)
    opens[rows] = True
    opens = opens[:n]
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    before[opens] = 9
    after_blank = np.zeros(n, bool)
    after_blank[1:] = points[:-1] == 32
    after_blank &= before == SPACE
    starts = (kind != before) & ~((kind != SPACE) & after_blank)
    closing = np.zeros(n, bool)
    closing[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~opens[1:]
    starts |= closing
    marks = np.flatnonzero((points == 39) & starts)
    if len(marks):
        ends = rows[np.searchsorted(rows, marks, "right")]
        one = points[np.minimum(marks + 1, n - 1)]
        two = points[np.minimum(marks + 2, n - 1)]
        short = (marks + 1 < ends) & np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
        long = (marks + 2 < ends) & (pairs[0] | pairs[1] | pairs[2])
        hit = marks[short | long]
        rest = hit + np.where(short[short | long], 2, 3)
        starts[hit + 1] = False
        rest = rest[rest < ends[short | long]]
        starts[rest[kind[rest] == LETTER]] = True
    first = np.flatnonzero(starts)
    bounds = np.append(place[first], len(raw)).tolist()
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(bounds, bounds[1:])], np.searchsorted(first, rows)


def _lift(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray) -> None:
    """Renew the inner nodes above one leaf in each of ``rows``."""
    node = leaf >> 1
    while node[0]:
        tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        node = node >> 1


def _merge_rows(pieces: list[bytes], width: int, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of pieces of 2 to ``width`` bytes (a power of two), and how many each piece has."""
    many = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, many)
    data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(many, width)
    token = vocab.bytes_rank[data]
    place = np.arange(width)
    after = np.broadcast_to(place + 1, (many, width)).copy()
    back = np.broadcast_to(place - 1, (many, width)).copy()
    tree = np.full((many, 2 * width), NONE, np.int64)
    ranks = vocab.bytes_pair[data[:, :-1].astype(np.int64) << 8 | data[:, 1:]]
    starts = (ranks < NONE) & (place[1:] < size[:, None])
    tree[:, width : 2 * width - 1] = np.where(starts, ranks << 32 | place[:-1], NONE)
    level = width >> 1
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level >>= 1
    live = place < size[:, None]
    row = np.flatnonzero(tree[:, 1] < NONE)
    while len(row):
        root = tree[row, 1]
        here = root & PLACE
        gone = after[row, here]
        then = after[row, gone]
        token[row, here] = root >> 32
        live[row, gone] = False
        after[row, here] = then
        inner = then < size[row]
        back[row[inner], then[inner]] = here[inner]
        tree[row, width + gone] = NONE
        _lift(tree, row, width + gone)
        fresh = np.full(len(row), NONE, np.int64)
        if inner.any():
            rank = vocab.pair(token[row[inner], here[inner]], token[row[inner], then[inner]])
            fresh[inner] = np.where(rank < NONE, rank << 32 | here[inner], NONE)
        tree[row, width + here] = fresh
        _lift(tree, row, width + here)
        left = back[row, here]
        has = left >= 0
        if has.any():
            r, a = row[has], left[has]
            rank = vocab.pair(token[r, a], token[r, here[has]])
            tree[r, width + a] = np.where(rank < NONE, rank << 32 | a, NONE)
            _lift(tree, r, width + a)
        row = row[tree[row, 1] < NONE]
    return token[live].astype(np.int32), live.sum(axis=1)


def _merge_long(piece: bytes, vocab: Vocabulary) -> np.ndarray:
    """The same merges for one long piece, on a tree of Python ints."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    token = vocab.bytes_rank[np.frombuffer(piece, np.uint8)]
    none = int(NONE)
    ranks = vocab.pair(token[:-1], token[1:])
    leaves = np.full(width, NONE, np.int64)
    leaves[: n - 1] = np.where(ranks < NONE, ranks << 32 | np.arange(n - 1), NONE)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = [none, *np.concatenate(levels[::-1]).tolist()]
    token = token.tolist()
    after, back = list(range(1, n + 1)), list(range(-1, n - 1))
    known = vocab.known

    def put(leaf: int, value: int) -> None:
        node = width + leaf
        tree[node] = value
        node >>= 1
        while node:
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    def start(a: int, b: int) -> int:
        rank = known.get(token[a] << 32 | token[b])
        return none if rank is None else rank << 32 | a

    alive = [True] * n
    while (root := tree[1]) < none:
        here = root & PLACE
        gone = after[here]
        then = after[gone]
        token[here], alive[gone], after[here] = root >> 32, False, then
        put(gone, none)
        if then < n:
            back[then] = here
        put(here, start(here, then) if then < n else none)
        if back[here] >= 0:
            put(back[here], start(back[here], here))
    return np.array([t for t, a in zip(token, alive) if a], np.int32)


def merge_pieces(pieces: list[bytes], vocab: Vocabulary) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(order, ids, sizes): token ids piece by piece in ``order``, places in ``pieces``.

    A piece that is a token itself is that token.
    """
    order, ids, sizes = [], [], []
    by_width: dict[int, list[int]] = {}
    whole = list(map(vocab.rank.get, pieces))
    for i, piece in enumerate(pieces):
        if whole[i] is None:
            by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
    known = [i for i, rank in enumerate(whole) if rank is not None]
    order += known
    ids.append(np.array([whole[i] for i in known], np.int32))
    sizes.append(np.ones(len(known), np.int64))
    for width, places in by_width.items():
        order += places
        if width > WIDE:
            parts = [_merge_long(pieces[i], vocab) for i in places]
            ids += parts
            sizes.append(np.array([len(p) for p in parts], np.int64))
            continue
        step = max(1, ROWS_WIDTH // width)
        for lo in range(0, len(places), step):
            some, many = _merge_rows([pieces[i] for i in places[lo : lo + step]], width, vocab)
            ids.append(some)
            sizes.append(many)
    return order, np.concatenate(ids), np.concatenate(sizes)


def spread(begin: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The slices ``data[begin : begin + size]`` end to end."""
    ends = np.cumsum(size)
    return data[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Encodes blocks, remembering the ids of pieces seen.

    Memory is bounded: beyond ``CACHE_PIECES`` pieces only those of the last block are kept, and the
    pieces seen before become the older generation, from which a piece that comes again is taken over.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.older: tuple = ({}, None, None, None)
        self._begin()

    def _begin(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.ids, self.begin, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _add(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.begin)
        self.seen.update(zip(pieces, range(first, first + len(pieces))))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def _learn(self, fresh: list[bytes]) -> None:
        known, ids, begin, size = self.older
        again = [p for p in fresh if p in known]
        if again:
            at = np.array([known[p] for p in again], np.int64)
            self._add(again, spread(begin[at], size[at], ids), size[at])
            fresh = [p for p in fresh if p not in known]
        if fresh:
            order, ids, sizes = merge_pieces(fresh, self.vocab)
            self._add([fresh[i] for i in order], ids, sizes)

    def block(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows in a block, and the rows' offsets among them."""
        pieces, rows = split_pieces(raw, at)
        found = list(map(self.seen.get, pieces))
        if None in found:
            fresh = list({p for p, f in zip(pieces, found) if f is None})
            if len(self.seen) + len(fresh) > CACHE_PIECES:
                self.older = (self.seen, self.ids, self.begin, self.size)
                self._begin()
                fresh = list(set(pieces))
            self._learn(fresh)
            found = list(map(self.seen.__getitem__, pieces))
        index = np.array(found, np.int64)
        size = self.size[index]
        ends = np.concatenate([[0], np.cumsum(size)])
        return spread(self.begin[index], size, self.ids), ends[rows]


def _encode(batches, vocab) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(vocab.value)
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, raw, at in K.blocks(batch.column("text")):
            flat, ends = encoder.block(raw, at)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), lists], ["doc_id", "ids"])


def _decode(batches, table: list[bytes]) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(t) for t in table], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    data = np.frombuffer(b"".join(table), np.uint8)
    step = 1 << 12
    for whole in batches:
        for lo in range(0, len(whole), step):
            batch = whole.slice(lo, step)
            lists = batch.column("ids").fill_null([])
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(sizes[flat])])
            out = spread(begin[flat], sizes[flat], data)
            decoded = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(batch), [None, pa.py_buffer(at[ends]), pa.py_buffer(out)]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), decoded.cast(pa.binary())], ["doc_id", "ids", "decoded"]
            )


def bpe_encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, special tokens being ordinary text.

    The vocabulary is built once on the driver (its size is fixed) and broadcast.  A null text
    is empty and has no ids; doc_id is passed through, null or repeated; other columns are ignored.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(load_ranks(ranks_path)))
    return K.bounded(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")).mapInArrow(
        lambda it: _encode(it, vocab), "doc_id bigint, ids array<int>"
    )


def bpe_round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded): :func:`bpe_encode` and :func:`bpe_decode` in one pass, so that a task
    needs one Python worker and the ids cross to it and back once."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(load_ranks(ranks_path)))
    return K.bounded(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")).mapInArrow(
        lambda it: _decode(_encode(it, vocab), vocab.value.tokens), "doc_id bigint, ids array<int>, decoded binary"
    )


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for; null ids decode to no bytes."""
    tokens = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    return K.bounded(encoded.select("doc_id", "ids")).mapInArrow(
        lambda it: _decode(it, tokens.value), "doc_id bigint, ids array<int>, decoded binary"
    )
