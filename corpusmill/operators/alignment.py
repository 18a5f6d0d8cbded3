"""Parallel texts: verse joins, translation units, parallel links and sentence alignment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verses(left: DataFrame, right: DataFrame) -> DataFrame:
    """number, left, right: verses on both sides; the last of repeated numbers counts. Inputs: number, text, at."""
    last = lambda df, name: df.groupBy("number").agg(F.max_by("text", "at").alias(name))
    return last(left, "left").join(last(right, "right"), "number")


def unit_pairs(tu: DataFrame) -> DataFrame:
    """Translation units with text on both sides."""
    return tu.where("trim(src_text) <> '' and trim(tgt_text) <> ''")


def switched(tu: DataFrame) -> DataFrame:
    """Source and target exchanged."""
    return tu.select("file", "tu_no", F.col("tgt_lang").alias("src_lang"), F.col("tgt_text").alias("src_text"), F.col("src_lang").alias("tgt_lang"), F.col("src_text").alias("tgt_text"))


def missing_parallels(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Claims (doc_id, other) whose other document doesn't exist."""
    return claims.join(docs.select(F.col("doc_id").alias("other")), "other", "left_anti")


def closure(claims: DataFrame) -> DataFrame:
    """a, b: claimed links in both directions, and those between two documents that a third one links."""
    both = claims.select(F.col("doc_id").alias("a"), F.col("other").alias("b")).union(claims.select("other", "doc_id")).where("a <> b").distinct()
    through = both.alias("x").join(both.alias("y"), F.expr("x.b = y.a")).select("x.a", "y.b").where("a <> b")
    return both.union(through).distinct()


def symmetric(claims: DataFrame) -> DataFrame:
    """Claims that hold in both directions."""
    back = claims.select(F.col("other").alias("doc_id"), F.col("doc_id").alias("other"))
    return claims.join(back, ["doc_id", "other"], "left_semi")


# Probabilities of the kinds of beads, and the variance, of Gale and Church (1993).
BEADS = {(1, 1): 0.89, (1, 0): 0.0099, (0, 1): 0.0099, (2, 1): 0.089, (1, 2): 0.089, (2, 2): 0.011}
VARIANCE = 6.8


def _cost(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How unlikely it is that texts of these lengths are translations: minus the logarithm of the probability that they differ by so much."""
    z = np.abs(y - x) / np.sqrt(np.maximum(VARIANCE * (x + y) / 2, 1e-9)) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)  # the complementary error function by its usual polynomial
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return np.where(x + y > 0, -np.log(np.maximum(tail, 1e-12)), 0.0)


def _hits(a: list[str], b: list[str], anchors: dict[str, set[str]]) -> dict[tuple[int, int], set[str]]:
    """Anchor words of sentence i whose partners stand in sentence j, by (i, j); only pairs that have some."""
    places: dict[str, list[int]] = {}
    for j, s in enumerate(b):
        for w in set(s.lower().split()):
            places.setdefault(w, []).append(j)
    found: dict[tuple[int, int], set[str]] = {}
    for i, s in enumerate(a):
        for w in set(s.lower().split()) & anchors.keys():
            for j in {j for other in anchors[w] for j in places.get(other, ())}:
                found.setdefault((i, j), set()).add(w)
    return found


def _bonuses(hits: dict[tuple[int, int], set[str]]) -> dict[tuple[int, int], dict[tuple[int, int], int]]:
    """For each kind of bead: how many anchor words a bead that ends before (i, j) has, where it has any."""
    out: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
    for m, n in BEADS:
        if m and n:
            own: dict[tuple[int, int], set[str]] = {}
            for (i, j), words in hits.items():
                for x in range(m):
                    for y in range(n):
                        own.setdefault((i + x + 1, j + y + 1), set()).update(words)
            out[m, n] = {at: len(words) for at, words in own.items()}
    return out


def align_lists(a: list[str], b: list[str], anchors: dict[str, set[str]] | None = None, width: int = 64) -> list[tuple[list[int], list[int]]]:
    """Beads (places in a, places in b) of least total cost; a pair of anchor words on both sides makes a bead cheaper.

    The programme runs over anti-diagonals, as whole arrays, in a band of `width` cells on either side of the straight path. If its best
    path comes to the edge of the band, the band is doubled and it runs again, up to the whole table. Of beads of one cost the first kind counts.
    """
    n, m = len(a), len(b)
    bonuses = _bonuses(_hits(a, b, anchors)) if anchors else {}
    by_sum: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = {}
    for kind, own in bonuses.items():
        for (i, j), k in own.items():
            if i <= n and j <= m:
                by_sum.setdefault(kind, {}).setdefault(i + j, []).append((j, k))
    ca, cb = (np.concatenate([[0], np.cumsum([len(x) for x in side])]).astype(float) for side in (a, b))
    while True:
        low = lambda d: max(0, d - n, math.floor(d * m / max(1, n + m)) - width)
        high = lambda d: min(m, d, math.ceil(d * m / max(1, n + m)) + width)
        rows, steps = {0: (0, np.zeros(1))}, [np.zeros(1, np.int8)]
        for d in range(1, n + m + 1):
            lo, hi = low(d), high(d)
            j = np.arange(lo, hi + 1)
            best, kind_of = np.full(len(j), np.inf), np.zeros(len(j), np.int8)
            for k, ((x, y), p) in enumerate(BEADS.items()):
                if d - x - y not in rows:
                    continue
                first, before = rows[d - x - y]
                at = j - y - first
                i = d - j - x
                ok = (at >= 0) & (at < len(before)) & (i >= 0) & (j >= y)
                if not ok.any():
                    continue
                cost = np.full(len(j), np.inf)
                jj, ii = j[ok], i[ok]
                cost[ok] = before[at[ok]] - math.log(p) + _cost(ca[ii + x] - ca[ii], cb[jj] - cb[jj - y])
                for column, words in by_sum.get((x, y), {}).get(d, ()):
                    if lo <= column <= hi:
                        cost[column - lo] -= words
                better = cost < best
                best[better], kind_of[better] = cost[better], k
            rows[d] = (lo, best)
            rows.pop(d - 5, None)
            steps.append(kind_of)
        out, i, j, edge = [], n, m, False
        kinds = list(BEADS)
        while i or j:
            lo, hi = low(i + j), high(i + j)
            edge |= (j == lo and lo > max(0, i + j - n)) or (j == hi and hi < min(m, i + j))
            x, y = kinds[steps[i + j][j - lo]]
            out.append((list(range(i - x, i)), list(range(j - y, j))))
            i, j = i - x, j - y
        if not edge or width >= n + m:
            return out[::-1]
        width *= 2


#: Anchor pairs that travel to the tasks at most.
ANCHOR_ROWS = 1_000_000


def anchor_table(pairs: DataFrame) -> dict[str, set[str]]:
    """Anchor pairs (w1, w2) by their first word, in small letters; more than ANCHOR_ROWS are an error."""
    rows = pairs.limit(ANCHOR_ROWS + 1).collect()
    if len(rows) > ANCHOR_ROWS:
        raise ValueError(f"more than {ANCHOR_ROWS} anchor pairs")
    found: dict[str, set[str]] = {}
    for w1, w2 in rows:
        found.setdefault(w1.lower(), set()).add(w2.lower())
    return found


def aligned_sentences(left: DataFrame, right: DataFrame, key: str | list[str], anchors: DataFrame | None = None) -> DataFrame:
    """key (columns), bead, src_text, tgt_text for each pair of documents. Inputs: key, sentence_no, sentence; anchors: (w1, w2)."""
    keys = [key] if isinstance(key, str) else key
    table = anchor_table(anchors) if anchors is not None else None

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        there = lambda d: "sentence_no" in d.columns and len(d) > 0  # noqa: E731  a side without rows may come without columns
        x, y = (d.sort_values("sentence_no")["sentence"].tolist() if there(d) else [] for d in (a, b))
        k = (a if there(a) else b)[keys].iloc[0].tolist()
        rows = [(*k, n, " ".join(x[i] for i in p), " ".join(y[j] for j in q)) for n, (p, q) in enumerate(align_lists(x, y, table), 1)]
        return pd.DataFrame(rows, columns=[*keys, "bead", "src_text", "tgt_text"])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(one, ", ".join(f"{k} bigint" for k in keys) + ", bead int, src_text string, tgt_text string")


def diff_lines(pairs: DataFrame, key: str) -> DataFrame:
    """key, differing: lines that only the gold side has, minus one for the head line of a diff; -1 when both are equal. Inputs: key, gold, test."""
    import difflib

    @F.pandas_udf("int")
    def count(gold: pd.Series, test: pd.Series) -> pd.Series:
        return pd.Series([sum(x.startswith("-") for x in difflib.unified_diff(a.split("\n"), b.split("\n"), n=0, lineterm="")) - 1 for a, b in zip(gold, test, strict=True)], dtype="int32")

    return pairs.select(key, count("gold", "test").alias("differing"))
