"""Vectorised kernels over Arrow text columns, used inside ``mapInArrow`` tasks.

A column of strings is one UTF-8 buffer plus row offsets; words, shingles and n-grams of a whole
block of rows are then a handful of numpy passes.  Blocks are cut at ``BLOCK_BYTES`` and ``BLOCK_ROWS``
so that memory follows the block (or the single longest text), not the Arrow batch: a kernel holds about
a dozen 8-byte arrays of a block's length at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 18
BLOCK_ROWS = 1 << 12
KEPT_POWERS = 1 << 19
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
_DEFAULT_BATCH = "67108864b"

U64 = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def bounded(rows: DataFrame) -> DataFrame:
    """``rows`` as they are, once Arrow batches are bounded by bytes.

    A batch of 10,000 long texts would fill a worker; where the session has Spark's default (64 MB),
    it is set to ``BATCH_BYTES``, and a setting of the user's own stays.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_SETTING) == _DEFAULT_BATCH:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return rows


def gathered(rows: DataFrame, size: int, kind: type) -> np.ndarray:
    """An array of ``size`` from ``rows`` of (place int, value bigint), each place once; the others are 0.

    The rows come as Arrow batches: a Row object for each would take the driver a hundred bytes and more.
    """
    out = np.zeros(size, kind)
    for batch in rows.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(kind)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A full-avalanche finaliser over uint64 (returns a new array)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random uint64 values."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_GOLDEN) + U64(seed * 0x632BE59BD9B4E019 & _MASK))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand.

    At most ``KEPT_POWERS`` are kept; a longer text gets a table of its own, gone with the text.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > KEPT_POWERS:
            return _powers(self.base, n), _powers(self.inverse, n)
        if len(self.up) < n:
            size = min(KEPT_POWERS, max(n, 2 * len(self.up), 1 << 16))
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up[:n], self.down[:n]


LETTERS = seeded(256, 7)
BYTE_POWERS = Powers(0x5851F42D4C957F2D)
WORD_POWERS = Powers(0x2545F4914F6CDD1D)
WORD_POWERS2 = Powers(0x369DEA0F31A53F85)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII bytes other than letters and digits.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if not len(at):
        at = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(array: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive blocks of about ``limit`` bytes and ``BLOCK_ROWS``."""
    raw, at = column(array)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + BLOCK_ROWS)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block: byte ranges, 64-bit hashes, and word offsets by row.

    ``lower`` folds A-Z only, as the operators' contracts ask; ``blank`` says which bytes part words.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, lower: bool = True, blank: np.ndarray = SPACE):
        n = len(raw)
        text = LOWER[raw] if lower else raw
        inside = ~blank[raw]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | edge[1:n]
            last[:-1] &= ~inside[1:] | edge[1:n]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.starts, at)
        up, down = BYTE_POWERS.get(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(LETTERS[text] * up[:n], out=sums[1:])
        size = (self.ends - self.starts).astype(U64)
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + size * U64(_GOLDEN))

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive items (length ``len - size + 1``, or empty)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    up, _ = WORD_POWERS.get(size)
    total = hashes[:n] * up[0]
    for k in range(1, size):
        total += hashes[k : k + n] * up[k]
    return mix(total + U64(size * _GOLDEN & _MASK))


def sequence_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's whole word sequence."""
    counts = np.diff(words.at)
    place = np.arange(len(words.hashes)) - np.repeat(words.at[:-1], counts)
    most = int(counts.max(initial=0))
    out = []
    for powers in (WORD_POWERS, WORD_POWERS2):
        up, _ = powers.get(max(most, 1))
        sums = np.zeros(len(words.hashes) + 1, U64)
        np.cumsum(words.hashes * up[place], out=sums[1:])
        out.append(mix(sums[words.at[1:]] - sums[words.at[:-1]] + counts.astype(U64) * U64(_GOLDEN)))
    return out[0], out[1]


def shingle_rows(words: Words, size: int = 5) -> Iterator[np.ndarray]:
    """Per row: the sorted distinct hashes of its ``size``-word shingles.

    A row with fewer words has one shingle, the whole sequence; a row without words has none.
    """
    whole, _ = sequence_keys(words)
    every = grams(words.hashes, size)
    for row, (a, b) in enumerate(zip(words.at[:-1].tolist(), words.at[1:].tolist())):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        elif b > a:
            yield whole[row : row + 1]
        else:
            yield whole[:0]


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 seen as int64, for Spark's bigint."""
    return np.ascontiguousarray(x).view(np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one array per row."""
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind))
