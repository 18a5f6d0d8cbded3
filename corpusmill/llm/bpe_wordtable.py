"""Byte-level BPE encoding and decoding through a distinct-word table.

Texts are split into words where the vocabulary's own pattern splits them at a space (at every border of the pattern, if a text
has odd white space), every word's merges are worked out once, and the ids are joined
back to the words by position. The table of distinct words is built over all documents: words are counted per batch, summed
by word, and those above the least count that lets at most TABLE_WORDS of at most WORD_BYTES each through are encoded once
in a distributed pass and travel to the tasks as a broadcast of proven bound. Rarer words (most occur once in the whole
corpus) are encoded where they stand, each distinct one once in a process: joining them through a shuffle as well would move
more than the input does. Decoding joins ids to the vocabulary's pieces and concatenates their bytes.

The results equal those of the tokenizers library with add_special_tokens=False: special tokens written out in a text become
their own id, as they do there.

Defined cases: a null text is encoded as an empty one, with no ids; repeated rows get equal ids; an empty input gives an empty
table; other columns named in `keep` pass through.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import _shared, _words

TABLE_WORDS, WORD_BYTES = 1 << 17, 64
#: Fixed value: the split pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of words besides the table that a Python process remembers, and words that it counts before it hands them on.
MEMO_BYTES, COUNT_WORDS = 48 << 20, 200_000
#: White space next to a space.
_ODD = re.compile(r" \s|\s ").search


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 characters stand for themselves, the others follow from U+0100."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Vocabulary:
    """What a vocabulary file holds; read where it is used, on the driver or in a task, from its text."""

    source: str
    special: dict[str, int]

    @classmethod
    def read(cls, path: str | Path) -> Vocabulary:
        source = Path(path).read_text(encoding="utf-8")
        return cls(source, {t["content"]: t["id"] for t in json.loads(source)["added_tokens"]})

    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.source)

    def encoder(self):
        """A function from a text to its ids. Where merges are in the order of their ids, as ranks are, the faster library does it."""
        model = json.loads(self.source)["model"]
        special = set(self.special.values())
        pieces = {piece: k for k, piece in self.pieces().items() if k not in special}
        ordered = all(model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] == 256 + k for k, m in enumerate(model["merges"]))
        if ordered and len(pieces) == 256 + len(model["merges"]):
            import tiktoken

            return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pieces, special_tokens={}).encode_ordinary
        tokenizer = self.tokenizer()
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def pieces(self) -> dict[int, bytes]:
        letters = _byte_letters()
        model = json.loads(self.source)["model"]["vocab"]
        out = {k: bytes(letters[c] for c in piece) for piece, k in model.items()}
        return out | {k: piece.encode() for piece, k in self.special.items()}


class Worker:
    """Splits, encodes and decodes in one Python process; ids are kept as decimal text, ready to be joined."""

    def __init__(self, vocabulary: Vocabulary, table: dict[str, str]):
        self.split = regex.compile(PATTERN).findall
        specials = sorted(vocabulary.special, key=len, reverse=True)
        self.specials = specials
        self.cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")").split if specials else lambda t: [t]
        self.marks = {s: str(k) for s, k in vocabulary.special.items()}
        self.one = vocabulary.encoder()
        self.piece = {str(k): v for k, v in vocabulary.pieces().items()}
        self.table, self.memo, self.size = table, {}, 0

    def words(self, text: str) -> list[str]:
        """The parts of a text that are encoded apart. A single space between two characters that aren't white space always
        begins a new word of the pattern, so such texts are cut there and nowhere else; others are cut by the pattern."""
        if any(s in text for s in self.specials):
            out: list[str] = []
            for k, part in enumerate(self.cut(text)):
                out += [part] if k % 2 else self.split(part)
            return out
        if _ODD(text):
            return self.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]

    def ids_of(self, words: list[str]) -> list[str]:
        """Ids of distinct words, each as decimal numbers joined by commas."""
        one = self.one
        return [self.marks.get(w) or ",".join(map(str, one(w))) for w in words]

    def encode(self, texts: list[str]) -> list[str]:
        """The decimal ids of each text, joined by commas."""
        out = []
        known, memo = self.table.get, self.memo
        for text in texts:
            words = self.words(text)
            ids = list(map(known, words))
            for k in [k for k, x in enumerate(ids) if x is None]:
                w = words[k]
                x = memo.get(w)
                if x is None:
                    x = memo[w] = self.marks.get(w) or ",".join(map(str, self.one(w)))
                    self.size += len(w) + len(x) + 100
                ids[k] = x
            if self.size > MEMO_BYTES:
                memo.clear()
                self.size = 0
            out.append(",".join(ids))
        return out

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids.split(","))) if ids else b""


#: One worker for each Python process, by the broadcast it was made from.
_workers: dict[str, Worker] = {}


def _texts(part: pa.RecordBatch) -> list[str]:
    return [t or "" for t in part.column("text").to_pylist()]


def word_counts(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, n) over all texts; each task sums its own words before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count = Worker(vocabulary, {}), Counter()
        for part, _ in _words.chunks(batches):
            for text in _texts(part):
                count.update(split.words(text))
            if len(count) > COUNT_WORDS:
                yield pa.RecordBatch.from_pydict({"word": list(count), "n": list(count.values())}, _COUNT)
                count.clear()
        yield pa.RecordBatch.from_pydict({"word": list(count), "n": list(count.values())}, _COUNT)

    return documents.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


_COUNT = pa.schema([("word", pa.string()), ("n", pa.int64())])


def word_table(documents: DataFrame, vocabulary: Vocabulary, most: int = TABLE_WORDS) -> dict[str, str]:
    """The frequent words with their ids: at most `most` words of at most WORD_BYTES, by a least count that no tie straddles."""
    counts = _shared.Written(word_counts(documents, vocabulary).where((F.col("n") > 1) & (F.octet_length("word") <= WORD_BYTES)))
    # distinct counts are few: a word seen n times takes n places in the corpus
    steps = F.floor(F.log2("n") * 16).alias("step")
    levels = sorted(counts.read().groupBy(steps).agg(F.count("*").alias("k")).collect(), reverse=True)
    total, least = 0, None
    for step, k in levels:
        if (total := total + k) > most:
            break
        least = step
    if least is None:
        counts.drop()
        return {}
    frequent = counts.read().where(F.floor(F.log2("n") * 16) >= least).select("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Worker(vocabulary, {})
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"word": words, "ids": worker.ids_of(words)})

    found = frequent.mapInArrow(run, "word string, ids string").toArrow()
    counts.drop()
    return dict(zip(found["word"].to_pylist(), found["ids"].to_pylist(), strict=True))


def encode(documents: DataFrame, vocabulary: Vocabulary, table: dict[str, str] | None = None, keep: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """`keep`, n_tokens, ids (decimal, comma-joined) and, with `decoded`, the text decoded from them again."""
    table = word_table(documents, vocabulary) if table is None else table
    shared, key = documents.sparkSession.sparkContext.broadcast((vocabulary, table)), uuid.uuid4().hex
    base = documents.select(*keep, *([] if "text" in keep else ["text"]))
    extra = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType())] + [T.StructField("decoded", T.StringType())] * decoded
    schema = T.StructType([*documents.select(*keep).schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers:
            _workers.clear()
            _workers[key] = Worker(*shared.value)
        worker = _workers[key]
        for part, _ in _words.chunks(batches):
            ids = worker.encode(_texts(part))
            arrays = [*(part.column(c) for c in keep), pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()), pa.array(ids, pa.string())]
            if decoded:
                arrays.append(pa.array([worker.decode(x).decode("utf-8", "replace") for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return base.mapInArrow(run, schema)
