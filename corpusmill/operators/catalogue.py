"""A corpus as a table of files: which are converted and by what, which stages lack, who is parallel to whom."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def convertable(files: DataFrame, gold: bool) -> DataFrame:
    """Files that a run takes: those of status correct* for gold documents, else standard and ocr ones. A file without a status is an error."""
    status = F.coalesce("status", F.raise_error(F.concat(F.lit("no conversion status: "), F.col("path"))).cast("string"))
    return files.where(F.startswith(status, F.lit("correct")) if gold else status.isin("standard", "ocr"))


def to_write(files: DataFrame, lazy: bool) -> DataFrame:
    """Converted documents that are written: of a known status, with text, and, if lazy, missing or older than one of their sources. Inputs: status, text, converted, sources (times)."""
    known = F.col("status").isin("standard", "ocr") | F.startswith("status", F.lit("correct"))
    rows = files.where(known & (F.length("text") > 0))
    return rows.where(F.col("converted").isNull() | (F.array_max("sources") > F.col("converted"))) if lazy else rows


def analysable(docs: DataFrame) -> DataFrame:
    """Documents that are analysed: not those read from images."""
    return docs.where("status is distinct from 'ocr'")


def saveable(pages: DataFrame, least_words: int) -> DataFrame:
    """Fetched pages that are kept: with text, more than `least_words` words, and in the language they claim."""
    return pages.where((F.length("text") > 0) & (F.col("words") > least_words) & (F.col("claimed") == F.col("detected")))


def stage_gaps(files: DataFrame) -> DataFrame:
    """Files of each stage and how many the next one lacks, over the whole corpus. Inputs: flags converted, analysed."""
    c = F.count_if
    return files.agg(F.count("*").alias("original"), c("converted").alias("converted"), c("analysed").alias("analysed"), c(~F.col("converted")).alias("not_converted"), c(F.col("converted") & ~F.col("analysed")).alias("not_analysed"))


def claim_totals(claims: DataFrame, docs: DataFrame, described: DataFrame) -> DataFrame:
    """total, missing, undescribed: claims (doc_id, other), those whose other document doesn't exist, and those where it has no metadata."""
    there = docs.select(F.col("doc_id").alias("other"), F.lit(True).alias("there"))
    meta = described.select(F.col("doc_id").alias("other"), F.lit(True).alias("meta"))
    rows = claims.join(there, "other", "left").join(meta, "other", "left")
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("there") & F.col("meta").isNull()).alias("undescribed"))


def repeated_members(files: DataFrame, key: str, text: str) -> DataFrame:
    """digest, key of every file whose text another one has too: one row a member, so a large group of copies needs no list."""
    rows = files.select(F.md5(text).alias("digest"), key)
    often = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(often, "digest", "left_semi")


def pair_sides(docs: DataFrame, other: str) -> DataFrame:
    """doc_id, source, target of the documents that have a parallel in the language `other`: a document translated from it is the target. Inputs: doc_id, translated_from, parallels (language to document)."""
    twin = F.try_element_at("parallels", F.lit(other))
    translated = F.coalesce(F.col("translated_from") == other, F.lit(False))
    rows = docs.select("doc_id", twin.alias("twin"), translated.alias("translated")).where("twin is not null")
    return rows.select("doc_id", F.when(F.col("translated"), F.col("twin")).otherwise(F.col("doc_id")).alias("source"), F.when(F.col("translated"), F.col("doc_id")).otherwise(F.col("twin")).alias("target"))


def sibling_versions(pages: DataFrame, group: str, key: str) -> DataFrame:
    """group, lang, key and `others`: for one page in several languages, the page of each other language. One page a language counts, the smallest key; a group is as large as there are languages."""
    one = pages.groupBy(group, "lang").agg(F.min(key).alias(key))
    sets = one.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", key)))).alias("all"))
    rows = sets.select(group, "all", F.explode("all").alias("lang", key))
    return rows.select(group, "lang", key, F.map_filter("all", lambda k, _: k != F.col("lang")).alias("others"))


def wanted_languages(models: DataFrame, wanted: list[str]) -> DataFrame:
    """lang, known: the wanted languages (all that have a model, if none is named), each once; `known` is false where there is no model, which a caller warns of."""
    have = models.select("lang").distinct()
    if not wanted:
        return have.select("lang", F.lit(True).alias("known"))
    asked = models.sparkSession.createDataFrame([(w,) for w in sorted(set(wanted))], "lang string")
    return asked.join(have.withColumn("known", F.lit(True)), "lang", "left").select("lang", F.coalesce("known", F.lit(False)).alias("known"))


def run_statistics(runs: DataFrame, by: str) -> DataFrame:
    """Per value of `by`: files that went well and that failed, bytes, bytes a second. Inputs: ok, bytes, seconds."""
    rate = F.sum(F.when(F.col("ok"), F.col("bytes"))) / F.nullif(F.sum(F.when(F.col("ok"), F.col("seconds"))), F.lit(0))
    return runs.groupBy(by).agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.sum("bytes").alias("bytes"), rate.cast("double").alias("bytes_a_second"))


def reading_order(paras: DataFrame, key: str) -> DataFrame:
    """Paragraphs without those marked `skip`, those marked `later` after all others; `place` counts from 1 in a document."""
    rows = paras.where("not skip").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("later", "para_no", "text"))).alias("ps"))
    return rows.select(key, F.posexplode("ps").alias("k", "p")).select(key, (F.col("k") + 1).alias("place"), "p.para_no", "p.text")


def run_stamp(at: Column) -> Column:
    """Time of a run as its reports write it."""
    return F.date_format(at, "yyyyMMdd-HHmm")


def published_year(date: Column) -> Column:
    """Year of a date written dd.mm.yyyy."""
    return F.substring(date, 7, 4)


def merged_metadata(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A metadata table after an update: a new row takes the place of the old one with its key, field by field where the new one says something."""
    both = old.alias("o").join(new.alias("n"), key, "full")
    fields = [c for c in old.columns if c != key]
    return both.select(key, *(F.coalesce(F.expr(f"nullif(n.`{c}`, '')"), F.col(f"o.{c}")).alias(c) for c in fields))


def stale(now: DataFrame, built: DataFrame, key: str = "doc_id") -> DataFrame:
    """key of documents that have to be built anew: those whose digest isn't the one that they were built from, and those that were never built. Inputs: key, digest."""
    return now.join(built.select(key, F.col("digest").alias("__built")), key, "left").where("not (digest <=> __built)").select(key)


def stale_pairs(pairs: DataFrame, changed: DataFrame, key: str = "doc_id") -> DataFrame:
    """source, target of pairs of which a side has changed: what a document's change reaches along its parallels. A pair without a built result counts as changed through its documents."""
    ids = changed.select(F.col(key).alias("__id"))
    return pairs.join(ids, F.col("source") == F.col("__id"), "left_semi").union(pairs.join(ids, F.col("target") == F.col("__id"), "left_semi")).distinct()


def refreshed(old: DataFrame, affected: DataFrame, keys: list[str], rebuild: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results with the affected rows built anew, and a flag `rebuilt`; rows that nothing reaches are taken over as they are."""
    kept = old.join(affected, keys, "left_anti").withColumn("rebuilt", F.lit(False))
    return kept.unionByName(rebuild(affected).withColumn("rebuilt", F.lit(True)))
