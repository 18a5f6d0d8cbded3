"""Vectorised word hashing over UTF-8 text: numpy passes over whole Arrow columns, no per-word Python.

A word is a maximal run of bytes whose entry in a 256-entry class table is true. Its hash is a rolling polynomial over
a random byte table, taken modulo 2**64 from one prefix sum, and mixed. Words never join across two documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass handles; bounds the memory of a worker whatever the size of an Arrow batch.
CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20_250_101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Lower-cases A-Z only.
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32


def _class(spec: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    if spec == "alnum":  # the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
        for lo, hi in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
            table[lo : hi + 1] = True
    else:  # "blank": everything but ASCII white space
        table[:] = True
        table[[0x20, 9, 10, 11, 12, 13]] = False
    return table


ALNUM, NONBLANK = _class("alnum"), _class("blank")

_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, CHUNK_BYTES + (1 << 16))
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(m, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that any bits of a hash may be used alone."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """The words of some documents: hash, start and end byte in `data`, document of each, and first word of each document."""

    data: np.ndarray
    doc_start: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # n_docs + 1 entries
    prefix: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash that a word from start to end would have."""
        return mix((self.prefix[end] - self.prefix[start]) * _pow(len(self.data) + 1)[1][start] + (end - start).astype(np.uint64))


def split_words(texts: list[bytes], word_class: np.ndarray = ALNUM, fold: np.ndarray = LOWER_AZ, hashed: bool = True) -> Words:
    """All words of the texts in order. `fold` maps bytes first; without `hashed` there are places only."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    doc_start = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes + 1, out=doc_start[1:])
    data = fold[np.frombuffer(b" ".join(texts) + b" ", np.uint8)] if texts else np.empty(0, np.uint8)
    inside = word_class[data]
    if len(texts) and word_class[32]:
        inside[doc_start[1:] - 1] = False
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    prefix = h = np.empty(0, np.uint64)
    if hashed:
        power, inverse = _pow(len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=prefix[1:])
        h = mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, doc_start)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, doc_start, h, start, end, doc, first, prefix)


def windows(w: Words, n: int, gaps: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every run of n words inside one document; gaps: offsets of the words taken, in place of 0..n-1."""
    offsets = gaps if gaps is not None else tuple(range(n))
    span = offsets[-1]
    m = len(w) - span
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.full(m, np.uint64(len(offsets) * 0x632BE59BD9B4E019 & (1 << 64) - 1), np.uint64)
    for o in offsets:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w.hash[o : o + m])
    keep = w.doc[:m] == w.doc[span:]
    return h[keep], np.flatnonzero(keep)


def encode(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "replace")


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `size` bytes of text each (a single longer text stands alone), and their texts."""
    for batch in batches:
        texts = [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]
        at, held = 0, 0
        for k, t in enumerate(texts):
            if held and held + len(t) > size:
                yield batch.slice(at, k - at), texts[at:k]
                at, held = k, 0
            held += len(t)
        if at < len(texts):
            yield batch.slice(at), texts[at:]
