"""Language identification by cross-parsing against suffix automata.

One suffix automaton per language indexes every substring of a bounded sample of that language's training text. A document
is parsed greedily into longest phrases that occur in the sample (Ziv and Merhav's cross-parsing); the fewer phrases per
symbol, the lower the cross entropy. The language with the fewest normalised phrases wins, ties to the smaller name.

Texts are folded to letters and single spaces first. Parsing runs in numpy on many lanes at once: a document is dealt into
segments of SEGMENT symbols (a phrase ends where its segment ends, for every language alike) and every step moves all lanes
of all languages one symbol. No shuffle is needed; the automata travel as edge lists of bounded size.

A language's sample is an excerpt of EXCERPT characters from each of SAMPLE_ROWS texts, at a place that a hash of the id names (the
whole text, if shorter), so texts of every length take part. With very many languages excerpts get shorter, so that all automata
together index ALL_BYTES at most; every language that occurs is learned.

Defined cases: null texts and texts without a letter are `und` with score 0; a very long text is parsed whole, in lanes; repeated
rows score alike; rows that repeat an id with several languages teach the largest; an empty table gives an empty result and, in training,
makes every text `und`; null languages are not learned. Columns besides doc_id and text pass through only if in `keep`,
whatever their names: the result is one struct.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import _labelled, _words

#: Bounds of the training sample: texts of a language, characters of an excerpt, characters of all languages.
SAMPLE_ROWS, EXCERPT, ALL_BYTES = 120, 400, 1_200_000
SEGMENT = 512
CHUNK_BYTES = 2 << 20
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z and the capitals of U+00C0-U+00DE in UTF-8; all bytes that aren't letters become spaces."""
    data = _words.LOWER_AZ[data]
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data = data + np.where(capital, 0x20, 0).astype(np.uint8)
    return np.where(_LETTER[data], data, 0x20).astype(np.uint8)


def squeeze(data: np.ndarray) -> np.ndarray:
    """Mask that keeps the first of every run of spaces."""
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    return keep


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring (Blumer et al. 1985, online construction)."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@dataclass
class Model:
    """Languages in name order; the automata's edges with states numbered through; symbol of each folded byte (0: never seen)."""

    langs: list[str]
    roots: np.ndarray
    n_states: int
    src: np.ndarray
    sym: np.ndarray
    dst: np.ndarray
    symbol: np.ndarray

    @property
    def n_symbols(self) -> int:
        return int(self.symbol.max()) + 1

    def key(self) -> str:
        return hashlib.sha256(b"".join(x.tobytes() for x in (self.roots, self.src, self.sym, self.dst, self.symbol)) + "\0".join(self.langs).encode()).hexdigest()


def fit(texts: dict[str, list[bytes]]) -> Model:
    langs = sorted(texts)
    folded = {}
    for lang in langs:
        f = fold(np.frombuffer(b"".join(t + b" " for t in texts[lang]), np.uint8))
        folded[lang] = f[squeeze(f)]
    seen = np.unique(np.concatenate([*folded.values(), np.array([0x20], np.uint8)]))
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    roots, src, sym, dst, n = [], [], [], [], 0
    for lang in langs:
        automaton = suffix_automaton(symbol[folded[lang]].tolist())
        roots.append(n)
        for k, edges in enumerate(automaton):
            src += [n + k] * len(edges)
            sym += edges.keys()
            dst += [n + v for v in edges.values()]
        n += len(automaton)
    as32 = lambda x: np.array(x, np.int32)
    return Model(langs, as32(roots), n, as32(src), as32(sym), as32(dst), symbol)


_tables: dict[str, np.ndarray] = {}


def _table(model: Model, key: str) -> np.ndarray:
    """Dense transitions, once in each Python worker."""
    if key not in _tables:
        _tables.clear()
        t = np.full(model.n_states * model.n_symbols, -1, np.int32)
        t[model.src.astype(np.int64) * model.n_symbols + model.sym] = model.dst
        _tables[key] = t
    return _tables[key]


def phrases(texts: list[bytes], model: Model, key: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(phrases of each text by language, symbols of each text)."""
    n, width = len(texts), model.n_symbols
    table = _table(model, key or model.key())
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, n)
    data = fold(np.frombuffer(b" ".join(texts) + b" ", np.uint8)) if n else np.empty(0, np.uint8)
    doc = np.repeat(np.arange(n), sizes)
    keep = squeeze(data)
    starts = np.cumsum(sizes) - sizes
    keep[starts] = data[starts] != 0x20  # no space at the head of a text
    data, doc = data[keep], doc[keep]
    symbols = np.bincount(doc, minlength=n)
    code = model.symbol[data].astype(np.int32)
    first = np.cumsum(symbols) - symbols
    lanes_of = -(-symbols // SEGMENT)
    lane_doc = np.repeat(np.arange(n), lanes_of)
    nth = np.arange(len(lane_doc)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
    lane_at = first[lane_doc] + nth * SEGMENT
    lane_len = np.minimum(SEGMENT, symbols[lane_doc] - nth * SEGMENT)
    order = np.argsort(-lane_len, kind="stable")
    lane_doc, lane_at, lane_len = lane_doc[order], lane_at[order], lane_len[order]
    roots = model.roots.astype(np.int64)[:, None]
    from_root = table.reshape(model.n_states, width)[model.roots]
    from_root = np.where(from_root < 0, model.roots[:, None], from_root)
    state = np.repeat(roots, len(lane_doc), axis=1)
    count = np.zeros((len(model.langs), len(lane_doc)), np.int32)
    active = np.searchsorted(-lane_len, -np.arange(SEGMENT), side="left")  # lanes longer than step k
    for k in range(int(lane_len[0]) if len(lane_len) else 0):
        m = active[k]
        c = code[lane_at[:m] + k]
        to = table[state[:, :m] * width + c]
        miss = to < 0
        count[:, :m] += miss
        state[:, :m] = np.where(miss, from_root[:, c], to)
    out = np.stack([np.bincount(lane_doc, row, n) for row in count]) if len(lane_doc) else np.zeros((len(model.langs), n))
    return out.T + lanes_of[:, None], symbols


def classify(texts: list[bytes], model: Model, key: str | None = None) -> tuple[list[str], np.ndarray]:
    langs, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
    if texts and model.langs:
        p, symbols = phrases(texts, model, key)
        rate = p / np.maximum(symbols, 1)[:, None]
        best = rate.argmin(1)
        low = rate[np.arange(len(texts)), best]
        second = np.partition(rate, 1, axis=1)[:, 1] if rate.shape[1] > 1 else np.full(len(texts), np.inf)
        lettered = np.array([_has_letter(t) for t in texts], bool)
        langs[lettered] = np.array(model.langs, object)[best[lettered]]
        share = np.ones(len(texts)) if rate.shape[1] == 1 else second / np.maximum(low + second, 1e-12)
        score[lettered] = share[lettered]
    return langs.tolist(), np.clip(score, 0, 1)


_ASCII_LETTERS = bytes(x for x in range(256) if not (0x41 <= x <= 0x5A or 0x61 <= x <= 0x7A))


def _has_letter(text: bytes) -> bool:
    head = text[:256]
    if len(head.translate(None, _ASCII_LETTERS)) or len(text.translate(None, _ASCII_LETTERS)):
        return True
    return not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "ignore")))


def train(documents: DataFrame, lang: str = "lang") -> Model:
    """A model from excerpts of a bounded number of training texts of each language."""
    ids = _labelled.sample_ids(documents, lang, per=SAMPLE_ROWS).toArrow()
    if not len(ids):
        return fit({})
    many = len(set(ids["label"].to_pylist()))
    size = max(20, min(EXCERPT, ALL_BYTES // (SAMPLE_ROWS * many)))
    sampled = documents.sparkSession.createDataFrame(ids)
    at = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.length("text") - size + 1, F.lit(1))) + 1
    found = _labelled.labelled(documents, sampled).select("doc_id", "label", F.substring("text", at, F.lit(size)).alias("text")).toArrow()
    found = found.sort_by([("label", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    texts: dict[str, list[bytes]] = {}
    for t, label in zip(found["text"].to_pylist(), found["label"].to_pylist(), strict=True):
        texts.setdefault(label, []).append(_words.encode(t))
    return fit(texts)


def predict(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), column: str = "found") -> DataFrame:
    """`keep` and a struct `column` of every row: held_out, lang_pred and score."""
    key = model.key()

    def judge(texts: list[bytes]) -> list[pa.Array]:
        langs, score = classify(texts, model, key)
        return [pa.array(langs, pa.string()), pa.array(score)]

    return _labelled.judged(documents, [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)], judge, keep, column, CHUNK_BYTES)
