"""License scans: winnowed fingerprints pick candidate places, banded sequence alignment measures them.

Templates and documents are cut into words (ASCII letters lower-cased); hashes of a few consecutive words are winnowed
(Schleimer et al. 2003) on both sides, and the fingerprints of the templates form an inverted index to (template, position). A match at
the accepted coverage leaves a run of unchanged words whose length the template's own length gives; gram and window of each template
follow from it, so such a run always shares a fingerprint. Hits on neighbouring diagonals name a candidate place, where the whole
template is aligned with the words around it in a band; coverage is the share of template words matched in order. Of places that
overlap, the one that matches most words is reported, then the one of greater coverage, of the earlier name, of the earlier place.

Nothing is shuffled; the templates travel with the function and are few by nature. Defined cases: null and empty texts have no
match; an empty table gives an empty result; a very long text is scanned whole, in time in proportion to its words and matches; repeated
rows match alike; templates without a word are left out; other columns pass through only if in `keep`, and what is found is one
struct whose name the caller chooses.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusmill.llm import _shared, _words
from corpusmill.llm._licenses import TEMPLATES

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 6, 0.8

MATCH = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]), False)


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of every window, the last of equal ones; all of them where there is less than a window."""
    if len(h) < window:
        return np.arange(len(h))
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(1))


def scheme(words: int, coverage: float = COVERAGE) -> tuple[int, int]:
    """(gram, window) for a template: a match that misses 1 - coverage of its words, wherever, still has a run of gram + window - 1."""
    gone = int(words * (1 - coverage) + 1e-9)
    run = -(-(words - gone) // (gone + 1))
    gram = min(GRAM, run if run <= 2 else run - 1)
    return gram, min(WINDOW, run - gram + 1)


@dataclass
class Index:
    """Templates by name, and for every scheme the winnowed fingerprints: hashes ascending, template and place of each."""

    names: list[str]
    words: list[np.ndarray]  # word hashes of each template
    postings: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def index(templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> Index:
    names, words, rows = [], [], {}
    for name, text in sorted((TEMPLATES if templates is None else templates).items()):
        w = _words.split_words([_words.encode(text)])
        if len(w):
            kind = scheme(len(w), coverage)
            h, at = _words.windows(w, kind[0])
            sel = winnow(h, kind[1])
            rows.setdefault(kind, []).append((h[sel], np.full(len(sel), len(names)), at[sel]))
            names.append(name)
            words.append(w.hash)
    postings = {}
    for kind, parts in rows.items():
        h, template, place = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort((place, template, h))
        postings[kind] = (h[order], template[order], place[order])
    return Index(names, words, postings)


def align(a: np.ndarray, b: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(words of a matched in order, first and past-last place in b) of the best alignment within `band` of the diagonal b = a + shift.

    Of the best, the one that ends first, then the one that begins last. A cell holds matches and, below them, the first place.
    """
    width = 2 * band + 1
    one, low = 1 << 32, (1 << 32) - 1
    before = np.zeros(width + 1, np.int64)
    at = np.arange(shift - band, shift + band + 1)
    for i in range(len(a)):
        j = at + i
        inside = (j >= 0) & (j < len(b))
        same = inside & (b[np.where(inside, j, 0)] == a[i]) if len(b) else inside
        longer = np.where(before[:width] >= one, before[:width] + one, one + j)
        now = np.maximum(np.where(same, longer, before[:width]), before[1:])
        before[:width] = np.maximum.accumulate(now)
        before[width] = 0
    matched = before[:width] >> 32
    m = int(matched.max())
    d = int(np.argmax(matched == m))
    return m, int(before[d] & low) if m else 0, int(at[d]) + len(a) if m else 0


def _diagonals(shifts: list[int], band: int) -> list[int]:
    """Diagonals whose bands cover all the given ones."""
    out: list[list[int]] = []
    for s in sorted(shifts):
        if out and s - out[-1][0] <= band:
            out[-1][1] = s
        else:
            out.append([s, s])
    return [(a + b) // 2 for a, b in out]


def scan(texts: list[bytes], ix: Index, coverage: float = COVERAGE) -> tuple[list[list[tuple[str, float, int, int]]], _words.Words]:
    """Matches (license, coverage, first word, past-last word) of each text in order."""
    w = _words.split_words(texts)
    out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
    places: dict[int, dict[int, set[int]]] = {}
    for (gram, window), (hashes, template, place) in ix.postings.items():
        h, at = _words.windows(w, gram)
        # windows may span texts here: a fingerprint more near a border, never one less
        sel = winnow(h, window)
        h, at = h[sel], at[sel]
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        for k in np.flatnonzero(hi > lo):
            doc = int(w.doc[at[k]])
            for i in range(lo[k], hi[k]):
                places.setdefault(doc, {}).setdefault(int(template[i]), set()).add(int(at[k] - w.first[doc] - place[i]))
    for doc, found in places.items():
        b = w.hash[w.first[doc] : w.first[doc + 1]]
        good = set()
        for t, shifts in found.items():
            a = ix.words[t]
            band = max(BAND, len(a) // 10)
            for shift in _diagonals(list(shifts), band):
                from_ = max(0, shift - band)
                m, s, e = align(a, b[from_ : max(0, shift + len(a) + band)], shift - from_, band)
                if m and m >= coverage * len(a) - 1e-9:
                    good.add((-m, -m / len(a), ix.names[t], s + from_, e + from_))
        taken: list[tuple[int, int]] = []  # disjoint, in order: only neighbours can overlap
        for _, c, name, s, e in sorted(good):
            k = bisect_left(taken, (s, e))
            if (k == 0 or taken[k - 1][1] <= s) and (k == len(taken) or taken[k][0] >= e):
                taken.insert(k, (s, e))
                out[doc].append((name, -c, s, e))
        out[doc].sort(key=lambda x: x[2])
    return out, w


def matches(documents: DataFrame, templates: dict[str, str] | None = None, keep: tuple[str, ...] = ("doc_id",), coverage: float = COVERAGE, column: str = "found") -> DataFrame:
    """`keep` and a struct `column` of every row: n_words and matches (license, coverage, start and end word)."""
    ix = index(templates, coverage)
    inner = T.StructType([T.StructField("n_words", T.LongType(), False), T.StructField("matches", MATCH, False)])
    schema = T.StructType([*documents.select(*keep).schema.fields, T.StructField(column, inner, False)])
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
    text = _shared.free_name(keep, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.chunks(batches, text):
            found, w = scan(texts, ix, coverage)
            rows = [[dict(zip(("license", "coverage", "start", "end"), m, strict=True)) for m in one] for one in found]
            both = pa.StructArray.from_arrays([pa.array(np.diff(w.first)), pa.array(rows, kind)], names=inner.names)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), both], names=schema.names)

    return documents.select(*keep, documents["text"].alias(text)).mapInArrow(run, schema)
