"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator (Kiryo et al. 2017).

Trusted positives are labelled good documents; the unlabelled set is web text drawn from all documents without looking at a
label. The class prior comes from the data too: the smallest ratio of the two score distributions' upper tails that a first
positive-against-unlabelled classifier gives on texts that it wasn't fitted on (a best-bin estimate). A one-layer network
over 24 shape statistics of a whole text is then trained by minimising the non-negative unbiased risk.

Statistics of the sampled rows are worked out where the rows are, so a text of any length takes part in fitting.

Defined cases: null and empty texts have all statistics at zero and are scored like any other; a very long text is scored whole, in
one task; repeated rows score alike; an empty table gives an empty result; with no positives every score is 0.5; columns besides
doc_id and text pass through only if named in `keep`, whatever their names: the result is one struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import _labelled, _words

#: Bounds of the positives and of the unlabelled sample, in rows.
POSITIVE_ROWS, UNLABELLED_ROWS = 3000, 3000
THRESHOLD = 0.3

_GROUPS = (range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), (0x20,), (0x0A,), b".", b",", b"!?", b"#$%&*+@^~", b"|<>{}[]\\/_=", b"-'\"():;", range(0x80, 0x100))
_GROUP_OF = np.full(256, len(_GROUPS), np.int64)
for _k, _bytes in enumerate(_GROUPS):
    _GROUP_OF[list(_bytes)] = _k
_N_GROUPS = len(_GROUPS) + 1
_IDENTITY = np.arange(256, dtype=np.uint8)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each document, from one sort of document and leading 44 bits."""
    key = np.sort(doc.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return np.bincount((key[fresh] >> np.uint64(44)).astype(np.int64), minlength=n)


def features(texts: list[bytes]) -> np.ndarray:
    """Shape statistics of each whole text: byte classes, word lengths, repetition of words, pairs and lines' worth of words."""
    n = len(texts)
    if not n:
        return np.empty((0, _N_GROUPS + 11))
    w = _words.split_words(texts, _words.NONBLANK, _IDENTITY)
    size = np.diff(w.doc_start) - 1
    doc_of = np.repeat(np.arange(n), size + 1)
    shares = np.bincount(doc_of * _N_GROUPS + _GROUP_OF[w.data], minlength=n * _N_GROUPS).reshape(n, _N_GROUPS).astype(float)
    shares[:, 3] -= 1  # the separator after each text
    shares /= np.maximum(size, 1)[:, None]
    count = np.diff(w.first)
    per = lambda weights: np.bincount(w.doc, weights, n) / np.maximum(count, 1)
    length = (w.end - w.start).astype(float)
    mean = per(length)
    spread = np.sqrt(np.maximum(per(length**2) - mean**2, 0))
    same = lambda k: np.concatenate([(w.hash[k:] == w.hash[:-k]) & (w.doc[k:] == w.doc[:-k]), np.zeros(min(k, len(w)), bool)]) if len(w) > k else np.zeros(len(w), bool)
    distinct = _distinct(w.doc, w.hash, n)
    h2, at2 = _words.windows(w, 2)
    pairs = _distinct(w.doc[at2], h2, n)
    last = w.data[np.maximum(w.end - 1, 0)] if len(w) else w.data
    odd_end = per(np.isin(_GROUP_OF[last], (7, 8, 9)).astype(float)) if len(w) else np.zeros(n)
    upper = per((_GROUP_OF[w.data[w.start]] == 0).astype(float)) if len(w) else np.zeros(n)
    c = np.maximum(count, 1)
    more = [np.log1p(count) / 10, mean / 10, spread / 10, per(same(1).astype(float)), per(same(2).astype(float)), distinct / c, np.log1p(distinct) / np.log1p(c), pairs / np.maximum(count - 1, 1), odd_end, upper, (length.size and np.bincount(w.doc, length > 20, n) / c) + np.zeros(n)]
    return np.column_stack([shares, *more])


@dataclass
class Model:
    """A network with one tanh layer over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float
    stats: dict = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((x - self.centre) / self.scale, -6, 6) @ w1 + b1) @ w2 + b2[0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(features(texts)), -40, 40)))


def _grad(x: np.ndarray, layers: list[np.ndarray], weight) -> tuple[float, list[np.ndarray]]:
    """Risk and gradient; weight(z) gives each row's loss and its slope."""
    w1, b1, w2, b2 = layers
    hid = np.tanh(x @ w1 + b1)
    loss, slope = weight(hid @ w2 + b2[0])
    back = np.outer(slope, w2) * (1 - hid**2)
    return float(loss.sum()), [x.T @ back, back.sum(0), hid.T @ slope, np.array([slope.sum()])]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _as_positive(k: float):
    return lambda z: (k * np.logaddexp(0, -z), k * (_sigmoid(z) - 1))


def _as_negative(k: float):
    return lambda z: (k * np.logaddexp(0, z), k * _sigmoid(z))


def risk(p: np.ndarray, u: np.ndarray, layers: list[np.ndarray], prior: float | None) -> tuple[float, list[np.ndarray]]:
    """The non-negative risk with logistic loss, and the direction to step against. prior None: plain risk of positives against unlabelled.

    Where the estimated risk on negatives falls below zero it counts as zero, and the step goes back on it alone.
    """
    ru, gu = _grad(u, layers, _as_negative(1 / len(u)))
    if prior is None:
        rp, gp = _grad(p, layers, _as_positive(1 / len(p)))
        return rp + ru, [a + b for a, b in zip(gp, gu, strict=True)]
    rp, gp = _grad(p, layers, _as_positive(prior / len(p)))
    rn, gn = _grad(p, layers, _as_negative(prior / len(p)))
    if ru < rn:
        return rp, [c - b for b, c in zip(gu, gn, strict=True)]
    return rp + ru - rn, [a + b - c for a, b, c in zip(gp, gu, gn, strict=True)]


def _optimise(xp: np.ndarray, xu: np.ndarray, prior: float | None, hidden: int, epochs: int, seed: int) -> list[np.ndarray]:
    """Adam on the risk of batches."""
    rng = np.random.default_rng(seed)
    d = xp.shape[1]
    layers = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    batch = 256
    for _ in range(epochs):
        up, uu = rng.permutation(len(xp)), rng.permutation(len(xu))
        for k in range(0, max(len(xp), len(xu)), batch):
            p = xp[up[np.arange(k, k + batch) % len(xp)]]
            u = xu[uu[np.arange(k, k + batch) % len(xu)]]
            t += 1
            for q, (par, grad) in enumerate(zip(layers, risk(p, u, layers, prior)[1], strict=True)):
                grad = grad + 1e-4 * par
                m[q] = 0.9 * m[q] + 0.1 * grad
                v[q] = 0.999 * v[q] + 0.001 * grad**2
                par -= 0.005 * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)
    return layers


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least upper-tail ratio, with a margin for the sampling error of each tail."""
    cuts = np.quantile(positive, np.linspace(0.0, 0.9, 91))
    tail = lambda s: np.array([(s >= c).mean() for c in cuts])
    qp, qu = tail(positive), tail(unlabelled)
    margin = np.sqrt(qu * (1 - qu) / len(unlabelled)) + np.sqrt(np.maximum(qp * (1 - qp), 0) / len(positive))
    k = int(np.argmin((qu + margin) / qp))
    return float(np.clip(qu[k] / qp[k], 0.05, 0.98))


def fit(xp: np.ndarray, xu: np.ndarray, prior: float | None = None, hidden: int = 16, epochs: int = 30) -> Model:
    """A model from the statistics of positive and of unlabelled texts."""
    if not len(xp) or not len(xu):
        d = xp.shape[1]
        return Model(np.zeros(d), np.ones(d), [np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), np.zeros(1)], 0.5)
    both = np.concatenate([xp, xu])
    centre, scale = both.mean(0), both.std(0) + 1e-3
    xp, xu = (np.clip((x - centre) / scale, -6, 6) for x in (xp, xu))
    if prior is None:
        half = lambda x: (x[::2], x[1::2]) if len(x) > 1 else (x, x)
        (pa_, pb), (ua, ub) = half(xp), half(xu)
        first = Model(np.zeros(xp.shape[1]), np.ones(xp.shape[1]), _optimise(pa_, ua, None, hidden, epochs, 1), 0.5)
        prior = estimate_prior(first.raw(pb), first.raw(ub))
    return Model(centre, scale, _optimise(xp, xu, prior, hidden, epochs, 2), prior, {"positive": len(xp), "unlabelled": len(xu)})


def sampled_features(documents: DataFrame, ids: DataFrame) -> np.ndarray:
    """Statistics of the sampled rows, in the order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(features(texts)), pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = _labelled.labelled(documents, ids).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = sorted((r["doc_id"], r["x"]) for r in rows.mapInArrow(run, "doc_id bigint, x array<double>").collect())
    return np.array([x for _, x in found]).reshape(len(found), -1) if found else features([])


def train(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Positives from labelled rows of the training folds; unlabelled rows from all documents of those folds, labels unread."""
    good = _labelled.sample_ids(labels.where(F.col(label) == 1), label, POSITIVE_ROWS)
    web = _labelled.sample_ids(documents.select("doc_id", F.lit(0).alias("label")), "label", UNLABELLED_ROWS)
    return fit(sampled_features(documents, good), sampled_features(documents, web))


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",), column: str = "found") -> DataFrame:
    """`keep` and a struct `column` of every row: held_out, score and predicted."""

    def judge(texts: list[bytes]) -> list[pa.Array]:
        p = model.score(texts)
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return _labelled.judged(documents, [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)], judge, keep, column)
