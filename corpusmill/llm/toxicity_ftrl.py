"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each document is the set of its hashed word unigrams, bigrams, skip-grams (two words around one or two others) and stems. Per-coordinate
learning rates and the L1 term leave few non-zero weights, so a model is two short arrays that travel inside the scoring
function. Scoring needs no shuffle: a numpy pass over each Arrow batch hashes the words, keeps the hashes that carry weight
and sums each document's distinct ones.

Features of the sampled rows are worked out where the rows are, so a text of any length takes part in fitting.

Defined cases: null and empty texts get the bias alone; a very long text is scored whole, in one task; repeated rows score alike;
rows that repeat an id with several labels count as toxic; an empty table gives an empty result and, in training, the score 0.5 for
every text; columns besides doc_id and text pass through only if named in `keep`, whatever their names: the result is one struct.
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

#: Bound of the labelled sample that a model is fitted on: rows of each label.
SAMPLE_ROWS = 2000
FEATURE_BITS = 22
#: Offsets of the words of each kind of gram; stems are leading bytes of single words, for inflected forms.
GRAMS: tuple[tuple[int, ...], ...] = ((0,), (0, 1), (0, 2), (0, 3))
STEM_BYTES = (4, 5, 6)


def features(texts: list[bytes], bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every n-gram and skip-gram, with repeats."""
    w = _words.split_words(texts, _words.ALNUM, FOLD)
    docs, ids = [], []
    for gaps in GRAMS:
        h, at = _words.windows(w, len(gaps), gaps)
        docs.append(w.doc[at])
        ids.append((h >> np.uint64(64 - bits)).astype(np.int64))
    for k in STEM_BYTES:
        at = np.flatnonzero(w.end - w.start > k)
        h = w.range_hash(w.start[at], w.start[at] + k) * np.uint64(2 * k + 1)
        docs.append(w.doc[at])
        ids.append((h >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(ids)


FOLD = _words.LOWER_AZ


@dataclass
class Model:
    """Non-zero weights by feature, ascending."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = FEATURE_BITS
    stats: dict = field(default_factory=dict)

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.ids) and texts:
            held = np.zeros(1 << self.bits, bool)
            held[self.ids] = True
            doc, ids = features(texts, self.bits)
            keep = held[ids]
            pair = np.unique(doc[keep] << self.bits | ids[keep])
            w = self.weights[np.searchsorted(self.ids, pair & (1 << self.bits) - 1)]
            z += np.bincount(pair >> self.bits, w, len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def distinct_features(texts: list[bytes], bits: int = FEATURE_BITS) -> list[np.ndarray]:
    """The features of each text, ascending, without repeats."""
    doc, ids = features(texts, bits)
    pair = np.unique(doc << bits | ids)
    return np.split(pair & (1 << bits) - 1, np.searchsorted(pair >> bits, np.arange(1, len(texts)))) if texts else []


def fit(per_doc: list[np.ndarray], labels: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, epochs: int = 3, bits: int = FEATURE_BITS) -> Model:
    """One FTRL-proximal step for each document and epoch (McMahan et al. 2013, algorithm 1), in a fixed random order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for d in rng.permutation(len(per_doc)):
            f = per_doc[d]
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= l1, 0.0, (np.sign(zf) * l1 - zf) / ((beta + np.sqrt(nf)) / alpha + l2))
            b = -zb / ((beta + np.sqrt(nb)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -40, 40))) - labels[d]
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha * w
            n[f] = nf + g * g
            zb, nb = zb + g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b, nb + g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    ids = np.flatnonzero(w)
    return Model(ids, w[ids], -zb / ((beta + np.sqrt(nb)) / alpha), bits, {"documents": len(per_doc), "weights": len(ids)})


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """A model from a bounded sample of the labelled rows of the training folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.chunks(batches):
            found = pa.array([x.astype(np.int32) for x in distinct_features(texts)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label").cast(pa.int32()), found], names=["doc_id", "label", "features"])

    ids = _labelled.sample_ids(labels.where(labels[label].isin(0, 1)), label, per=rows)
    sample = _labelled.labelled(documents, ids).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")
    found = sample.mapInArrow(run, "doc_id bigint, label int, features array<int>").toArrow()
    order = sorted(range(len(found)), key=lambda k: (found["doc_id"][k].as_py(), len(found["features"][k]), found["features"][k].values.to_numpy().tobytes()))
    column = found["features"].combine_chunks()
    return fit([column[k].values.to_numpy().astype(np.int64) for k in order], found["label"].to_numpy()[order].astype(float))


def score(documents: DataFrame, model: Model, threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",), column: str = "found") -> DataFrame:
    """`keep` and a struct `column` of every row: held_out, score and predicted."""

    def judge(texts: list[bytes]) -> list[pa.Array]:
        p = model.score(texts)
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return _labelled.judged(documents, [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)], judge, keep, column)
