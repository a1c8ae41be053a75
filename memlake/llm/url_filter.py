"""URL filter on a sorted digest array.

Entries (host and path prefix) are kept as a sorted array of 64-bit xxhash keys beside their full
strings, in one file that executors map into memory.  A url's candidate keys, the host suffixes with
the path lengths that entries can have, are probed by one vectorised binary search per batch, and a hit
counts only if the stored string is equal.  Suffixes of more labels or bytes than any entry's host are
never built, so a url of any length makes only so many short keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import textkernels as K
from memlake.plans.scratch import scratch_root

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK, LISTED = 0, 1, 2
BATCH = 4096

# The rules of the contract (verdict, host, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Hosts that are blocked where no rule fits; a parameter, here with placeholder farms.
BLOCKED_HOSTS = ("adult-x.example.com", "casino-win.example.net", "spam-farm.example.org")


@dataclass(frozen=True)
class Entry:
    verdict: int
    host: str
    path: str


def entries(rules: Iterable = RULES, blocked_hosts: Iterable[str] = BLOCKED_HOSTS) -> list[Entry]:
    listed = [Entry(LISTED, h, "") for h in blocked_hosts]
    return [Entry(BLOCK if v == "block" else ALLOW, h, p) for v, h, p in rules] + listed


def digest(host: str, path: str, listed: bool) -> tuple[int, bytes]:
    """Key and full string; the mark keeps blocklist entries apart from rules of equal text."""
    full = f"{host}\0{path}\0{'b' if listed else 'r'}".encode()
    return xxhash.xxh64_intdigest(full), full


def index_bytes(items: list[Entry]) -> bytes:
    """The file: count, sorted digests, verdicts, string offsets, strings.

    Of entries with one host and path, the one that blocks wins.
    """
    strictest: dict[tuple, int] = {}
    for e in items:
        key = (e.host, e.path, e.verdict == LISTED)
        strictest[key] = max(strictest.get(key, e.verdict), e.verdict)
    rows = sorted((*digest(*key), verdict) for key, verdict in strictest.items())
    strings = [full for _, full, _ in rows]
    at = np.cumsum([0, *map(len, strings)]).astype("<i8")
    return b"".join([
        np.array([len(rows)], "<i8").tobytes(), np.array([d for d, _, _ in rows], "<u8").tobytes(),
        np.array([v for _, _, v in rows], "<i8").tobytes(), at.tobytes(), *strings,
    ])


class DigestIndex:
    """The index file mapped into memory."""

    def __init__(self, path: str):
        self.data = np.memmap(path, np.uint8, "r")
        n = int(self.data[:8].view("<i8")[0])
        self.digests = self.data[8 : 8 + 8 * n].view("<u8")
        self.verdicts = self.data[8 + 8 * n : 8 + 16 * n].view("<i8")
        self.at = self.data[8 + 16 * n : 16 + 24 * n].view("<i8")
        self.strings = self.data[16 + 24 * n :]

    def probe(self, keys: list[tuple[int, bytes]]) -> np.ndarray:
        """Place of each key's entry, or -1; keys of equal digest are told apart by their strings."""
        wanted = np.fromiter((d for d, _ in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        out = np.full(len(keys), -1)
        n = len(self.digests)
        for i in np.flatnonzero(self.digests[np.minimum(at, n - 1)] == wanted) if n else ():
            k = int(at[i])
            while k < n and self.digests[k] == wanted[i]:
                if self.strings[self.at[k] : self.at[k + 1]].tobytes() == keys[i][1]:
                    out[i] = k
                    break
                k += 1
        return out


def publish(spark: SparkSession, data: bytes) -> str:
    """Put the index into the shared folder and let Spark hand it to every executor; its name."""
    name = f"digests-{uuid.uuid4().hex[:12]}.bin"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())
    return name


@dataclass(frozen=True)
class Limits:
    """What any entry can match: path lengths of rules, and the most labels and characters of a host."""

    path_lengths: tuple[int, ...]
    labels: int
    characters: int

    @classmethod
    def of(cls, items: list[Entry]) -> Limits:
        lengths = tuple(sorted({len(e.path) for e in items if e.verdict != LISTED}))
        return cls(lengths, max((e.host.count(".") + 1 for e in items), default=0), max((len(e.host) for e in items), default=0))

    def suffixes(self, host: str) -> Iterator[str]:
        """The host's suffixes of whole labels, shortest first, as far as an entry could equal them."""
        at = len(host)
        for _ in range(self.labels):
            at = host.rfind(".", 0, at)
            if len(host) - at - 1 > self.characters:
                return
            yield host[at + 1 :]
            if at < 0:
                return


def _judge(batches, name: str, limits: Limits) -> Iterator[pa.RecordBatch]:
    index = DigestIndex(SparkFiles.get(name))
    for whole in batches:
        for lo in range(0, len(whole), BATCH):
            batch = whole.slice(lo, BATCH)
            keys, owner, text = [], [], []
            for row, (host, path) in enumerate(zip(batch.column("host"), batch.column("path"))):
                host, path = host.as_py(), path.as_py()
                for suffix in limits.suffixes(host) if host else ():
                    for length in limits.path_lengths:
                        if length <= len(path):
                            keys.append(digest(suffix, path[:length], False))
                            owner.append(row)
                            text.append((length + len(suffix), len(suffix), suffix + path[:length]))
                    keys.append(digest(suffix, "", True))
                    owner.append(row)
                    text.append(None)
            found = index.probe(keys)
            best: list[tuple | None] = [None] * len(batch)
            listed = [False] * len(batch)
            for i in np.flatnonzero(found >= 0):
                row = owner[i]
                if text[i] is None:
                    listed[row] = True
                else:
                    mine = (*text[i], int(index.verdicts[found[i]]))
                    best[row] = mine if best[row] is None else max(best[row], mine)
            verdicts = ["block" if (b[3] == BLOCK if b else on) else "allow" for b, on in zip(best, listed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"),
                 pa.array([b[2] if b else None for b in best], pa.string()), pa.array(verdicts, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )


def judge_urls(pages: DataFrame, items: list[Entry]) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every url in ``pages(page_id, url)``.

    The longest rule that fits (host or a domain above it, and a prefix of the path) decides; of two
    as long the one with the longer host.  Without a rule a url is blocked if its host or a domain
    above it is on the blocklist, else allowed; of two rules of the same text the one that blocks holds.
    A null url, or one without ``://``, has empty host and path and is allowed.  Rows pass through one to
    one, repeated ones too; other columns are ignored.
    """
    limits = Limits.of(items)
    name = publish(pages.sparkSession, index_bytes(items))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    parsed = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce(F.translate(F.regexp_extract("url", pattern, 1), UPPER, LOWER), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("url", pattern, 2), F.lit("")).alias("path"),
    )
    return K.bounded(parsed).mapInArrow(
        lambda it: _judge(it, name, limits),
        "page_id bigint, host string, path string, rule string, verdict string",
    )
