"""Bounded labelled samples for the trained operators, the fold rule that keeps their test rows out, and per-text judgements."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import _shared, _words

#: Every fifth document by this checksum is held out: no label, language or statistic of it reaches a model.
FOLDS = 5
#: Parts into which the rows of one label are dealt before its sample is taken, so that no task sees all of a frequent label.
PARTS = 32


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows of the test fold. A null id counts as not held out but is never trained on either."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % FOLDS == 0, F.lit(False))


def sample_ids(rows: DataFrame, label: str, limit: int | None = None, per: int | None = None) -> DataFrame:
    """At most `limit` training rows (doc_id, label) in the order of a hash of the id; repeated ids keep their largest label.

    per: at most so many rows of each label value instead. Nothing here depends on the texts.
    """
    train = rows.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    key = F.xxhash64(F.lit("sample"), "doc_id")
    if per is None:
        return train.orderBy(key, "doc_id").limit(limit)
    few = train.select("doc_id", "label", key.alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"))
    for by in (("label", "part"), ("label",)):
        few = few.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("key", "doc_id"))).where(F.col("nth") <= per).drop("nth")
    return few.select("doc_id", "label").orderBy("label", "key")


def labelled(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the sampled ids, whole texts. The id list is bounded by its sample, so it is broadcast and no text is shuffled."""
    texts = documents.select("doc_id", "text").where("text is not null")
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")


def judged(documents: DataFrame, fields: list[T.StructField], judge: Callable[[list[bytes]], list[pa.Array]], keep: tuple[str, ...] = ("doc_id",), column: str = "found", size: int = _words.CHUNK_BYTES) -> DataFrame:
    """`keep` and a struct `column` of every row: held_out and what judge(texts) gives, one Arrow array for each field.

    Only `column` could clash with a kept name, and the caller chooses it.
    """
    text, fold = (_shared.free_name(keep, n) for n in ("_text", "_fold"))
    base = documents.select(*keep, F.col("text").alias(text), held_out().alias(fold))
    inner = T.StructType([T.StructField("held_out", T.BooleanType(), False), *fields])
    schema = T.StructType([*documents.select(*keep).schema.fields, T.StructField(column, inner, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.chunks(batches, text, size):
            found = pa.StructArray.from_arrays([part.column(fold), *judge(texts)], names=inner.names)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), found], names=schema.names)

    return base.mapInArrow(run, schema)
