"""Queries on a corpus as a table of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import catalogue as C
from corpusmill.sources.tables import load

def _statuses(spark, d):
    """Documents as files; status, times and stages by a rule on the id."""
    k = F.col("doc_id")
    status = F.when(k % 11 == 0, "ocr").when(k % 7 == 0, "correct").when(k % 5 == 0, "correct-no-gs").when(k % 13 == 0, "new").otherwise("standard")
    return load(spark, d, "documents").select(k, F.concat(F.lit("/c/"), k).alias("path"), "lang", "source", "text", status.alias("status"), F.when(k % 3 > 0, k % 17).alias("converted"), F.array(k % 19, k % 4).alias("sources"), (k % 3 > 0).alias("is_converted"), (k % 9 > 3).alias("is_analysed"))


def convertable_files(spark, d):
    rows = _statuses(spark, d)
    both = [C.convertable(rows, gold).select("doc_id", F.lit(gold).alias("gold")) for gold in (False, True)]
    return both[0].union(both[1])


def written_documents(spark, d):
    rows = _statuses(spark, d)
    both = [C.to_write(rows, lazy).select("doc_id", F.lit(lazy).alias("lazy")) for lazy in (False, True)]
    return both[0].union(both[1])


def analysable_documents(spark, d):
    return C.analysable(_statuses(spark, d)).groupBy("lang", "status").agg(F.count("*").alias("n"))


def saveable_pages(spark, d):
    pages = load(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("claimed"), F.when(F.col("doc_id") % 6 == 0, "xx").otherwise(F.col("lang")).alias("detected"), X.word_count("text").alias("words"))
    return C.saveable(pages, 40).select("doc_id", "words")


def stage_gaps(spark, d):
    return C.stage_gaps(_statuses(spark, d).select(F.col("is_converted").alias("converted"), F.expr("is_converted and is_analysed").alias("analysed")))


def _claims(spark, d):
    docs = load(spark, d, "documents")
    return docs.where("doc_id % 3 = 0").select("doc_id", F.expr("doc_id + 7").alias("other")).union(docs.where("doc_id % 5 = 0").select("doc_id", F.expr("doc_id - 1")))


def parallel_totals(spark, d):
    docs = load(spark, d, "documents").select("doc_id").distinct()
    return C.claim_totals(_claims(spark, d), docs, docs.where("doc_id % 4 > 0"))


def dupe_members(spark, d):
    return C.repeated_members(load(spark, d, "documents"), "doc_id", "text")


def parallel_sides(spark, d):
    k = F.col("doc_id")
    docs = load(spark, d, "documents").select(k, F.when(k % 2 == 0, "nob").when(k % 3 == 0, "fin").alias("translated_from"), F.when(k % 5 == 0, F.create_map(F.lit("fin"), k + 2)).otherwise(F.create_map(F.lit("nob"), k + 1)).alias("parallels"))
    return C.pair_sides(docs, "nob")


def language_versions(spark, d):
    docs = load(spark, d, "documents").select(F.floor(F.col("doc_id") / 4).alias("page"), "lang", "doc_id").where("lang is not null")
    rows = C.sibling_versions(docs, "page", "doc_id")
    return rows.select("page", "lang", "doc_id", F.array_join(F.array_sort(F.transform(F.map_entries("others"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("others"))


def active_languages(spark, d):
    return C.wanted_languages(load(spark, d, "documents").where("lang is not null"), ["de", "en", "en", "sme", "zz"])


def run_statistics(spark, d):
    runs = load(spark, d, "documents").select("source", (F.length("text") > 400).alias("ok"), F.octet_length("text").cast("bigint").alias("bytes"), (1 + F.col("doc_id") % 4).alias("seconds"))
    return C.run_statistics(runs, "source")


def reading_order(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_no", "text"))
    marked = lines.withColumn("skip", F.col("para_no") % 4 == 2).withColumn("later", F.col("para_no") % 3 == 0)
    return C.reading_order(marked, "doc_id").select("doc_id", "place", "para_no", F.md5("text").alias("digest"))


def run_stamps(spark, d):
    e = load(spark, d, "events")
    return e.select(C.run_stamp(F.col("ts")).alias("stamp"), C.published_year(F.date_format("ts", "dd.MM.yyyy")).alias("year")).groupBy("stamp", "year").agg(F.count("*").alias("n"))


def metadata_update(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", "source")
    old = docs.where("doc_id % 3 < 2")
    new = docs.where("doc_id % 3 > 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("x-"), "lang")).alias("lang"), F.lit(None).cast("string").alias("source"))
    return C.merged_metadata(old, new, "doc_id")


def stale_parallels(spark, d):
    """Results of pairs of parallel documents after some texts have changed: only the pairs that a change reaches are built anew."""
    docs = load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    new = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" new"))).otherwise(F.col("text")))
    pairs = docs.select(F.col("doc_id").alias("source"), (F.col("doc_id") + 1).alias("target")).where("source % 4 < 2")

    def build(texts):
        one = lambda side: texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"{side}_text"))
        return lambda rows: rows.join(one("source"), "source").join(one("target"), "target").select("source", "target", F.md5(F.concat_ws("|", "source_text", "target_text")).alias("digest"))

    of = lambda texts: texts.select("doc_id", F.md5("text").alias("digest"))
    changed = C.stale(of(new), of(docs).where("doc_id % 50 <> 7"))
    return C.refreshed(build(docs)(pairs), C.stale_pairs(pairs, changed), ["source", "target"], build(new))


QUERIES = {
    f.__name__: f
    for f in (convertable_files, written_documents, analysable_documents, saveable_pages, stage_gaps, parallel_totals, dupe_members, parallel_sides, language_versions, active_languages, run_statistics, reading_order, run_stamps, metadata_update, stale_parallels)
}

_STATUS = """with f as (select doc_id, lang, text, case when doc_id % 11 = 0 then 'ocr' when doc_id % 7 = 0 then 'correct' when doc_id % 5 = 0 then 'correct-no-gs' when doc_id % 13 = 0 then 'new' else 'standard' end as status,
  case when doc_id % 3 > 0 then doc_id % 17 end as converted, greatest(doc_id % 19, doc_id % 4) as newest from documents) """
_OPEN = "status <> 'new' and length(text) > 0"
_WORDS = f"len(list_filter(regexp_split_to_array(text, '{X.WS}+'), lambda x: x <> ''))"
ORACLE = {
    "convertable_files": _STATUS + "select doc_id, false as gold from f where status in ('standard', 'ocr') union all select doc_id, true from f where status like 'correct%'",
    "written_documents": _STATUS + f"select doc_id, false as lazy from f where {_OPEN} union all select doc_id, true from f where {_OPEN} and (converted is null or newest > converted)",
    "analysable_documents": _STATUS + "select lang, status, count(*) as n from f where status <> 'ocr' group by all",
    "saveable_pages": f"select doc_id, words from (select doc_id, lang, text, {_WORDS} as words from documents) where length(text) > 0 and words > 40 and lang = case when doc_id % 6 = 0 then 'xx' else lang end",
    "stage_gaps": "select count(*) as original, count(*) filter (c) as converted, count(*) filter (c and a) as analysed, count(*) filter (not c) as not_converted, count(*) filter (c and not a) as not_analysed from (select doc_id % 3 > 0 as c, doc_id % 9 > 3 as a from documents)",
    "parallel_totals": """with c as (select doc_id + 7 as other from documents where doc_id % 3 = 0 union all select doc_id - 1 from documents where doc_id % 5 = 0), h as (select c.other, c.other in (select doc_id from documents) as there from c)
select count(*) as total, count(*) filter (not there) as missing, count(*) filter (there and other % 4 = 0) as undescribed from h""",
    "stale_parallels": """with n as (select doc_id, coalesce(text, '') || case when doc_id % 10 = 3 then ' new' else '' end as t from documents)
select a.doc_id as source, b.doc_id as target, md5(a.t || '|' || b.t) as digest, a.doc_id % 10 = 3 or b.doc_id % 10 = 3 or a.doc_id % 50 = 7 or b.doc_id % 50 = 7 as rebuilt
from n a join n b on b.doc_id = a.doc_id + 1 where a.doc_id % 4 < 2""",
    "dupe_members": "select md5(text) as digest, doc_id from documents where md5(text) in (select md5(text) from documents group by 1 having count(*) > 1)",
    "parallel_sides": "select doc_id, case when doc_id % 2 = 0 then doc_id + 1 else doc_id end as source, case when doc_id % 2 = 0 then doc_id else doc_id + 1 end as target from documents where doc_id % 5 <> 0",
    "language_versions": """with o as (select doc_id // 4 as page, lang, min(doc_id) as doc_id from documents where lang is not null group by all)
select a.page, a.lang, a.doc_id, coalesce(string_agg(b.lang || '=' || b.doc_id, ',' order by b.lang || '=' || b.doc_id), '') as others from o a left join o b on a.page = b.page and a.lang <> b.lang group by all""",
    "active_languages": "select w as lang, w in (select lang from documents where lang is not null) as known from (values ('de'), ('en'), ('sme'), ('zz')) as t(w)",
    "run_statistics": """select source, count(*) filter (ok) as ok, count(*) filter (not ok) as failed, sum(n)::bigint as bytes, (sum(n) filter (ok) / nullif(sum(s) filter (ok), 0))::double as bytes_a_second
from (select source, length(text) > 400 as ok, strlen(text) as n, 1 + doc_id % 4 as s from documents) group by source""",
    "reading_order": """select doc_id, row_number() over (partition by doc_id order by para_no % 3 = 0, para_no) as place, para_no, md5(line) as digest
from (select doc_id, generate_subscripts(l, 1) - 1 as para_no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)) where para_no % 4 <> 2""",
    "run_stamps": "select strftime(ts, '%Y%m%d-%H%M') as stamp, strftime(ts, '%Y') as year, count(*) as n from events group by all",
    "metadata_update": "select doc_id, case when doc_id % 3 > 0 and doc_id % 2 = 1 and lang is not null then 'x-' || lang when doc_id % 3 < 2 then lang end as lang, case when doc_id % 3 < 2 then source end as source from documents",
}
