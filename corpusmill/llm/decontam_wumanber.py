"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of 10 consecutive words of a benchmark item is a pattern (a shorter item is one pattern). As in Wu and Manber's
search, blocks of two words index a shift table that says how far the search may jump, a jump of zero selects a bucket by
the block's hash, and the words of the window are then compared directly, at last byte for byte. The symbols are words, so an
occurrence always begins and ends at word borders. numpy moves many search positions at once; long texts are dealt into
lanes that overlap by a window, so whole texts are searched. Each pattern length has tables of its own.

Only the patterns travel, at most SHARD_BYTES of item text in one pass over the documents; a larger benchmark takes several
passes, each adding its spans to the rows. Nothing is shuffled and the number of matches is unlimited.

Defined cases: null and empty texts have no words and no hits; items without a word have no pattern; repeated items count once
by item_id; an empty benchmark hits nothing; repeated documents are marked alike; other columns pass through
untouched, but for an older one of the result's name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import _words

WINDOW = 10
SHARD_BYTES = 16 << 20
LANE = 1024

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

HIT_TYPE = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_hit", T.LongType(), False),
        T.StructField("items", T.ArrayType(T.LongType(), False), False),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType(), False), False), False),
    ]
)


def item_words(text: str | None) -> list[bytes]:
    return _WORD.findall(_words.encode(text).translate(_AZ))


@dataclass
class Searcher:
    """Shift table, suffix buckets and patterns of one length."""

    length: int
    bits: int
    shift: np.ndarray
    suffix: np.ndarray  # block hash of each pattern's last words, ascending
    hashes: np.ndarray  # patterns x length
    text: list[bytes]
    items: list[tuple[int, ...]]


def _block(h: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of words that ends at each position."""
    return h[end] if size == 1 else _words.mix(h[end - 1] * np.uint64(0xD6E8FEB86659FD93) + h[end])


def compile_items(items: list[tuple[int, str | None]], window: int = WINDOW) -> list[Searcher]:
    by_length: dict[int, dict[bytes, set[int]]] = {}
    for item_id, text in items:
        words = item_words(text)
        n = min(window, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            by_length.setdefault(n, {}).setdefault(b" ".join(words[k : k + n]), set()).add(item_id)
    return [_compile(n, patterns) for n, patterns in sorted(by_length.items())]


def _compile(n: int, patterns: dict[bytes, set[int]]) -> Searcher:
    text = sorted(patterns)
    parts = [_words.split_words(text[k : k + 4096]) for k in range(0, len(text), 4096)]
    hashes = np.concatenate([p.hash for p in parts]).reshape(len(text), n)
    size = min(2, n)
    bits = int(np.clip(np.ceil(np.log2(8 * len(text) * n)), 10, 24))
    shift = np.full(1 << bits, n - size + 1, np.int16)
    for j in range(size - 1, n):
        block = hashes[:, j] if size == 1 else _words.mix(hashes[:, j - 1] * np.uint64(0xD6E8FEB86659FD93) + hashes[:, j])
        np.minimum.at(shift, (block >> np.uint64(64 - bits)).astype(np.int64), n - 1 - j)
    order = np.argsort(block, kind="stable")  # the block of the last words
    return Searcher(n, bits, shift, block[order], hashes[order], [text[k] for k in order], [tuple(sorted(patterns[text[k]])) for k in order])


def occurrences(w: _words.Words, s: Searcher) -> tuple[np.ndarray, np.ndarray]:
    """(first word, pattern) of every occurrence."""
    size = min(2, s.length)
    low, high = w.first[:-1] + s.length - 1, w.first[1:]
    lanes = np.maximum(-(-(high - low) // LANE), 0)
    doc = np.repeat(np.arange(len(lanes)), lanes)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = low[doc] + nth * LANE
    end = np.minimum(at + LANE, high[doc])
    found = []
    while len(at):
        jump = s.shift[(_block(w.hash, at, size) >> np.uint64(64 - s.bits)).astype(np.int64)]
        found.append(at[jump == 0])
        at = at + np.maximum(jump, 1)
        live = at < end
        at, end = at[live], end[live]
    last = np.concatenate(found) if found else np.empty(0, np.int64)
    block = _block(w.hash, last, size)
    lo, hi = np.searchsorted(s.suffix, block, "left"), np.searchsorted(s.suffix, block, "right")
    n = hi - lo
    last = np.repeat(last, n)
    pattern = np.repeat(lo, n) + np.arange(len(last)) - np.repeat(np.cumsum(n) - n, n)
    first = last - s.length + 1
    for j in range(s.length):  # word by word, so that most candidates end at the first comparison
        same = w.hash[first + j] == s.hashes[pattern, j]
        first, pattern = first[same], pattern[same]
    return _confirm(w, s, first, pattern)


def _confirm(w: _words.Words, s: Searcher, first: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data, ok = w.data.tobytes(), np.ones(len(first), bool)
    for k, (a, p) in enumerate(zip(first.tolist(), pattern.tolist(), strict=True)):
        ok[k] = b" ".join(_WORD.findall(data, w.start[a], w.end[a + s.length - 1])) == s.text[p]
    return first[ok], pattern[ok]


def search(texts: list[bytes], searchers: list[Searcher]) -> tuple[np.ndarray, np.ndarray, list[set[int]], _words.Words]:
    """(words of each text, whether each word is hit, items of each text, words)."""
    w = _words.split_words(texts)
    edge = np.zeros(len(w) + 1, np.int64)
    items: list[set[int]] = [set() for _ in texts]
    for s in searchers:
        first, pattern = occurrences(w, s)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + s.length, -1)
        for d, p in set(zip(w.doc[first].tolist(), pattern.tolist(), strict=True)):
            items[d].update(s.items[p])
    return np.diff(w.first), np.cumsum(edge[:-1]) > 0, items, w


def _shards(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items as bounded lists; a benchmark of more than SHARD_BYTES is read in as many parts as that takes."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // SHARD_BYTES)) if total > SHARD_BYTES else 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.toLocalIterator()]


def annotate(documents: DataFrame, items: DataFrame, window: int = WINDOW, column: str = "hit") -> DataFrame:
    """The rows of `documents` and a struct `column`: n_words, n_hit, items (ascending ids) and spans (word ranges [from, to) that are hit)."""
    out = documents.drop(column)
    for shard in _shards(items):
        out = _pass(out, compile_items(shard, window), column)
    return out


def _pass(documents: DataFrame, searchers: list[Searcher], column: str) -> DataFrame:
    again = column in documents.columns
    schema = T.StructType([f for f in documents.schema.fields if f.name != column] + [T.StructField(column, HIT_TYPE)])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.chunks(batches):
            count, hit, items, w = search(texts, searchers)
            before = part.column(column).to_pylist() if again else [None] * len(texts)
            rows = []
            for d, old in enumerate(before):
                mine = hit[w.first[d] : w.first[d + 1]]
                found = items[d]
                if old:
                    for a, b in old["spans"]:
                        mine[a:b] = True
                    found = found | set(old["items"])
                edge = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)) if found else np.empty(0, np.int64)
                rows.append({"n_words": int(count[d]), "n_hit": int(mine.sum()), "items": sorted(found), "spans": edge.reshape(-1, 2).tolist()})
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(rows, _ARROW_HIT)], names=[*names, column])

    return documents.mapInArrow(run, schema)


_ARROW_HIT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.list_(pa.int64())))])
