"""Secret scans: an Aho-Corasick keyword prefilter, regular expressions anchored at the hits only,
then embedded checksum validation.

All patterns are ASCII, so the automaton and the expressions run on UTF-8 bytes; spans are turned
into code points for the few texts that have any.
"""

from __future__ import annotations

import binascii
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memlake.llm import textkernels as K

# The kinds of the contract, in its order, then the checksummed ones.
BASE_KINDS = ("assign", "access", "hex")
MORE_KINDS = ("github", "npm", "xprv")
KINDS = BASE_KINDS + MORE_KINDS
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
XPRV = re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def _number(digits: bytes, alphabet: bytes) -> int:
    out = 0
    for d in digits:
        out = out * len(alphabet) + alphabet.index(d)
    return out


def base62_crc_holds(token: bytes) -> bool:
    """The last six signs are the base-62 CRC-32 of the rest after the prefix."""
    body = token[token.index(b"_") + 1 :]
    return _number(body[-6:], BASE62) == binascii.crc32(body[:-6])


def base58_check_holds(token: bytes) -> bool:
    """Base58Check: the last four bytes start the double SHA-256 of the rest."""
    data = _number(token, BASE58).to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


#: kind: (expression, is a match a finding)
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= MIN_VALUE),
    "access": (ACCESS, lambda m: len(m[0]) >= MIN_ACCESS),
    "github": (GITHUB, lambda m: base62_crc_holds(m[0])),
    "npm": (NPM, lambda m: base62_crc_holds(m[0])),
    "xprv": (XPRV, lambda m: base58_check_holds(m[0])),
}


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


Span = tuple[int, int, str, int]


def find_spans(raw: np.ndarray, at: np.ndarray, automaton) -> dict[int, list[Span]]:
    """By row of a block: (start, end, kind, start of the secret itself) in bytes of the row.

    Matches of one kind are leftmost and do not overlap; those that fail a length or a checksum are
    dropped after they have taken their place.
    """
    rows: dict[int, list[Span]] = {}
    hits: dict[tuple[int, str], list[int]] = {}
    ends = at[1:]
    for last, (kind, size) in automaton.iter(K.LOWER[raw].tobytes().decode("latin-1")):
        row = int(np.searchsorted(ends, last, "right"))
        start = last - size + 1 - int(at[row])
        if start >= 0:
            hits.setdefault((row, kind), []).append(start)
    for (row, kind), starts in hits.items():
        text = raw[at[row] : at[row + 1]].tobytes()
        expression, holds = RULES[kind]
        free = 0
        for start in sorted(set(starts)):
            match = expression.match(text, start) if start >= free else None
            if match:
                free = match.end()
                if holds(match):
                    value = match.start(2) if kind == "assign" else start
                    rows.setdefault(row, []).append((start, free, kind, value))
    inside = np.concatenate([[False], _HEX[raw], [False]])
    turn = inside[1:] != inside[:-1]
    cut = np.zeros(len(turn), bool)
    cut[at] = True
    begins = np.flatnonzero(inside[1:] & (turn | cut) & np.append(inside[1:-1], False))
    stops = np.flatnonzero(inside[:-1] & (turn | cut))
    long = stops - begins >= MIN_HEX
    for start, stop in zip(begins[long].tolist(), stops[long].tolist()):
        row = int(np.searchsorted(ends, start, "right"))
        first = int(at[row])
        rows.setdefault(row, []).append((start - first, stop - first, "hex", start - first))
    return rows


def _places(text: np.ndarray, spans: list[Span]) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, kind) in code points, in the order of the contract."""
    before = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    return sorted((int(before[s]), KINDS.index(kind), int(before[e]), kind) for s, e, kind, _ in spans)


def _join(places) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in places)


def _scan(batches) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, raw, at in K.blocks(batch.column("text")):
            counts = np.zeros((len(BASE_KINDS), hi - lo), np.int64)
            base, every = [""] * (hi - lo), [""] * (hi - lo)
            for row, spans in find_spans(raw, at, automaton).items():
                places = _places(raw[at[row] : at[row + 1]], spans)
                every[row] = _join(places)
                base[row] = _join(p for p in places if p[3] in BASE_KINDS)
                for p in places:
                    if p[1] < len(BASE_KINDS):
                        counts[p[1], row] += 1
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), *map(pa.array, counts), pa.array(base, pa.string()), pa.array(every, pa.string())],
                ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_spans", "spans"],
            )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_spans, spans) of every whole text.

    Spans are ``kind:start:end`` in code points (end exclusive), by start and then kind, joined by
    commas; ``spans`` adds the checksummed kinds.  A null text is empty and has none; null and
    repeated ids pass through; other columns are ignored.
    """
    return K.bounded(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")).mapInArrow(
        _scan,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string",
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret value in ``text`` replaced by ``mark``; n_chars follows, if present.

    Overlapping spans are replaced once.  Null texts stay null, other columns as they are.
    """
    put = mark.encode()
    at_text = docs.columns.index("text")
    at_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    schema = docs.schema

    def change(batches):
        automaton = _automaton()
        for batch in batches:
            texts = batch.column(at_text)
            fresh: dict[int, str] = {}
            for lo, _, raw, at in K.blocks(texts):
                for row, spans in find_spans(raw, at, automaton).items():
                    text, out, done = raw[at[row] : at[row + 1]].tobytes(), b"", 0
                    for start, end in sorted((value, end) for _, end, _, value in spans):
                        if end > done:
                            if start >= done:
                                out += text[done:start] + put
                            done = end
                    fresh[lo + row] = (out + text[done:]).decode("utf-8")
            columns = list(batch.columns)
            if fresh:
                values = texts.to_pylist()
                for row, text in fresh.items():
                    values[row] = text
                columns[at_text] = pa.array(values, texts.type)
                if at_chars is not None:
                    sizes = columns[at_chars].to_pylist()
                    for row, text in fresh.items():
                        sizes[row] = len(text)
                    columns[at_chars] = pa.array(sizes, columns[at_chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return K.bounded(docs).mapInArrow(change, schema)
