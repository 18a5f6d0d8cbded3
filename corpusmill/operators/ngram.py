"""Character and word n-gram models: counts, ranks, distances and classification of documents.

For models, words are counted per language before grams are made from the distinct ones, so the explode is over distinct words only.
A document is one row: its grams are counted, ranked and compared with the models inside it, and only languages and distances
leave the row. Order of first occurrence breaks ties of frequency.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X

CHAR_GRAMS, WORD_GRAMS, MISSING, DROP_RATIO = 400, 30_000, 400, 1.10
#: Models of at most so many rows travel to the tasks (400 rows a language); larger ones are joined.
MODEL_ROWS = 400_000


def tokens(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, i, j, token: white-space pieces cut at the split characters; empty tokens count."""
    at = docs.select(*keys, F.posexplode(X.pieces("text")).alias("i", "piece"))
    return at.select(*keys, "i", F.posexplode(F.split("piece", X.split_class(), -1)).alias("j", "token"))


def word_freq(docs: DataFrame, key: str) -> DataFrame:
    """key, token, n, first (place of the first occurrence)."""
    place = F.array(*(F.col(c).cast("long") for c in ("doc_id", "i", "j")))
    t = tokens(docs, *dict.fromkeys((key, "doc_id")))
    return t.groupBy(key, "token").agg(F.count("*").alias("n"), F.min(place).alias("first"))


def char_freq(docs: DataFrame, key: str) -> DataFrame:
    """key, gram, freq, first: substrings of one to four characters of every token with _ on either side."""
    w = F.concat(F.lit("_"), "token", F.lit("_"))
    size = F.length(w)

    def grams(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.least(F.lit(4), size - s + 1)), lambda k: F.struct(F.substring(w, s, k).alias("gram"), s.alias("s"), k.alias("k")))

    rows = word_freq(docs, key).select(key, "n", "first", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), size), grams))).alias("g"))
    place = F.concat("first", F.array(F.col("g.s").cast("long"), F.col("g.k").cast("long")))
    return rows.groupBy(key, F.col("g.gram").alias("gram")).agg(F.sum("n").alias("freq"), F.min(place).alias("first"))


def ranked(freq: DataFrame, key: str, gram: str, n: str, most: int) -> DataFrame:
    """The `most` frequent grams of each key with rank from 0. The empty gram takes a rank and goes."""
    w = Window.partitionBy(key).orderBy(F.desc(n), F.asc("first"))
    top = freq.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)  # in this form the limit reaches the sort
    return top.where(F.col(gram) != "").select(key, F.col(gram).alias("gram"), F.col(n).alias("freq"), (F.col("nth") - 1).cast("long").alias("rank"))


def char_model(docs: DataFrame, key: str = "lang", most: int = CHAR_GRAMS) -> DataFrame:
    return ranked(char_freq(docs, key), key, "gram", "freq", most)


def word_model(docs: DataFrame, key: str = "lang", most: int = WORD_GRAMS) -> DataFrame:
    """Word model with inverted ranks, scaled to the size of a full model."""
    top = ranked(word_freq(docs, key), key, "token", "n", most)
    size = F.count("*").over(Window.partitionBy(key))
    return top.withColumn("invrank", (size - F.col("rank")) / (size / F.lit(float(most))))


def top_grams(tokens: list[str], most: int = CHAR_GRAMS) -> list[str]:
    """The most frequent grams of one document in order; a dictionary keeps them in the order of their first occurrence."""
    count: dict[str, int] = {}
    for token, n in Counter(tokens).items():
        w = f"_{token}_"
        for s in range(len(w)):
            for k in range(s + 1, min(s + 4, len(w)) + 1):
                gram = w[s:k]
                count[gram] = count.get(gram, 0) + n
    return sorted(count, key=count.__getitem__, reverse=True)[:most]


def distances(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, distance: rank differences over the document's grams, MISSING for each that the model lacks."""
    rows = model.select("lang", "gram", "rank").limit(MODEL_ROWS + 1).toArrow()
    if len(rows) > MODEL_ROWS:
        return joined_distances(docs, model)
    langs = sorted(set(rows["lang"].to_pylist()))
    ranks: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, rank in zip(*(rows[c].to_pylist() for c in ("lang", "gram", "rank")), strict=True):
        ranks.setdefault(gram, []).append((langs.index(lang), rank))
    space, cut = (re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{m[1]:0>4}", p)) for p in (X.WS + "+", X.split_class()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, far = [], [], []
            for k, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                tokens = [t for piece in space.split(text or "") if piece for t in cut.split(piece)]
                grams = top_grams(tokens)
                distance = [MISSING * len(grams)] * len(langs)
                for rank, gram in enumerate(grams):
                    for at, other in ranks.get(gram, ()):
                        distance[at] += abs(rank - other) - MISSING
                ids += [k] * len(langs)
                names += langs
                far += distance
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(far, pa.int64())], names=["doc_id", "lang", "distance"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang string, distance bigint")


def joined_distances(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The same by joins, for models of any size. Only grams that meet the model are joined; the others are counted."""
    own = ranked(char_freq(docs, "doc_id"), "doc_id", "gram", "freq", CHAR_GRAMS)
    met = own.join(model.select("lang", "gram", F.col("rank").alias("m")), "gram").groupBy("doc_id", "lang").agg(F.sum(F.abs(F.col("rank") - F.col("m")) - MISSING).alias("gain"))
    size = own.groupBy("doc_id").agg(F.count("*").alias("grams"))
    langs = model.select("lang").distinct().agg(F.collect_set("lang").alias("langs")).first()["langs"]
    every = docs.select("doc_id").join(size, "doc_id", "left").withColumn("lang", F.explode(F.lit(sorted(langs)).cast("array<string>")))
    return every.join(met, ["doc_id", "lang"], "left").select("doc_id", "lang", (F.coalesce("grams", F.lit(0)) * MISSING + F.coalesce("gain", F.lit(0))).cast("long").alias("distance"))


def classify_char(distance: DataFrame) -> DataFrame:
    """doc_id, predicted, distance: nearest model, ties to the smaller language."""
    best = F.min(F.struct("distance", "lang"))
    return distance.groupBy("doc_id").agg(best.alias("b")).select("doc_id", F.col("b.lang").alias("predicted"), F.col("b.distance").alias("distance"))


def classify_full(docs: DataFrame, distance: DataFrame, words: DataFrame, ratio: float = DROP_RATIO) -> DataFrame:
    """doc_id, predicted, kept: languages near the best are told apart by their word models."""
    near = distance.withColumn("best", F.min("distance").over(Window.partitionBy("doc_id"))).where(F.col("distance") <= F.col("best") * ratio)
    near = near.withColumn("kept", F.count("*").over(Window.partitionBy("doc_id")))
    open_ = near.where("kept > 1")
    own = word_freq(docs.join(open_.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
    hits = own.join(words.select("lang", F.col("gram").alias("token"), "invrank"), "token").groupBy("doc_id", "lang").agg(F.sum(F.col("invrank") * F.col("invrank") * F.col("n") * 100).alias("w"))
    score = F.when(F.col("kept") == 1, F.col("distance").cast("double")).when(F.col("distance") <= 0, F.lit(0.0)).otherwise(F.col("distance") - F.coalesce("w", F.lit(0.0)) / F.col("distance"))
    scored = near.join(hits, ["doc_id", "lang"], "left").withColumn("score", score)
    return scored.groupBy("doc_id").agg(F.min(F.struct("score", "lang")).alias("b"), F.max("kept").alias("kept")).select("doc_id", F.col("b.lang").alias("predicted"), "kept")
