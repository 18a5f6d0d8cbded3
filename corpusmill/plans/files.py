"""Queries on files: documents and pages written as the bytes of many formats, and read again."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.plans.texts import _islands
from corpusmill.plans.webpages import PAGE_BLOCKS, quoted
from corpusmill.sources import reader as R
from corpusmill.sources.tables import load

#: Paths by id, in turn, the reader that each calls for, and the status of every fifth file.
_PATHS = [
    ("/c/corpus-sme/orig/a$.html", "html"), ("/c/corpus-sme/orig/b$.pdf", "outside"), ("/c/orig/avvir_xml/x$.xml", "newspaper"), ("/c/orig/bible/nt$-bible.xml", "bible"), ("/c/orig/udhr_$.xml", "articles"),
    ("/c/orig/k$.correct.txt", "marked errors"), ("/c/orig/k$.txt", "plain"), ("/c/orig/m$.sfm", "verses"), ("/c/orig/p$.svg", "svg"), ("/c/orig/q$.usx", "usx"), ("/c/orig/r$.xyz", None),
    ("/c/orig/no_suffix$", None), ("/c/orig/t$.docx", "outside"), ("/c/v1.txt/noname$", None), ("/c/orig/ocr$.PDF", None), ("/c/orig/other$.xml", None), ("/c/orig/$.epub", "epub"),
]


def reader_dispatch(spark, d):
    k = F.col("doc_id")
    path = F.replace(F.element_at(F.array(*(F.lit(p) for p, _ in _PATHS)), (k % len(_PATHS) + 1).cast("int")), F.lit("$"), k.cast("string"))
    return load(spark, d, "documents").select(k, R.reader_of(path, F.when(k % 5 == 0, "ocr").otherwise("standard")).alias("reader"))


#: What plain files keep of a document: letters that each of the encodings has.
_KEPT = "[^\\n\\x20-\\x3B\\x3D\\x3F-\\x7E\\x{a1}\\x{e0}-\\x{ff}]"


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _files(spark, d):
    """Documents as files: plain text in three encodings, pictures with text, verses, scripture XML, articles, newspaper stories, files that can't be read; and pages."""
    docs = load(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), _KEPT, "").alias("t"))
    k, kind = F.col("doc_id"), F.col("doc_id") % 10
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 1)
    joined = lambda before, after: F.array_join(F.transform("lines", lambda x: F.concat(F.lit(before), x, F.lit(after))), "")
    rows = docs.select(k, "t", F.transform(lines, _escaped).alias("lines"), lines.alias("bare"))
    text = (
        F.when(kind < 3, F.col("t"))
        .when(kind == 3, F.concat(F.lit("<svg xmlns='http://www.w3.org/2000/svg'><g>"), joined("<text><tspan>", "</tspan></text><path d='x'/>"), F.lit("</g></svg>")))
        .when(kind == 4, F.concat(F.lit("\\id x\n"), F.array_join(F.transform("bare", lambda x: F.concat(F.lit("\\s1 "), F.replace(x, F.lit("\\"), F.lit("")))), "\n")))
        .when(kind == 5, F.concat(F.lit("<usx><chapter number='1'/>"), joined("<para style='p'><verse number='1'/>", "<note>gone</note></para>"), F.lit("</usx>")))
        .when(kind == 6, F.concat(F.lit("<udhr xmlns='x'><preamble><title>not shown</title></preamble><article>"), joined("<para>", "</para>"), F.lit("</article></udhr>")))
        .when(kind == 7, F.concat(F.lit("<article><story id='1' class='Tittel'>"), joined("<p>", "<p>taken out</p></p>"), F.lit("</story><story id='1'><p>again</p></story></article>")))
        .when(kind == 8, F.concat(F.lit("<usx><para>"), k.cast("string")))
        .otherwise(F.lit("no reader"))
    )
    name = F.concat(F.when(kind == 6, F.lit("/c/udhr_")).when(kind == 7, F.lit("/c/avvir_xml/")).otherwise(F.lit("/c/")), k.cast("string"), F.element_at(F.array(*map(F.lit, (".txt", ".txt", ".txt", ".svg", ".sfm", ".usx", ".xml", ".xml", ".usx", ".zzz"))), (kind + 1).cast("int")))
    content = F.when(kind == 1, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    made = rows.select(name.alias("path"), content.alias("content"))
    return made.union(load(spark, d, "pages").select(F.concat(F.lit("/c/page"), F.col("page_id").cast("string"), F.lit(".html")), F.encode(F.coalesce("html", F.lit("")), "UTF-8")))


def mixed_files(spark, d):
    found = R.documents(_files(spark, d))
    said = F.array_join(F.transform("paragraphs", lambda p: F.concat_ws(":", p["type"], p["text"])), "\n")
    return found.select("path", "reader", F.size("paragraphs").alias("n"), F.md5(said).alias("digest"), F.col("error").isNotNull().alias("failed"))


_CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/b.opf"/></rootfiles></container>'


@F.pandas_udf(T.BinaryType())
def _packed(pages: pd.Series) -> pd.Series:
    """Pages as an e-book; a last part is outside of the reading order."""

    def one(htmls) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("META-INF/container.xml", _CONTAINER)
            n = len(htmls)
            items = "".join(f'<item id="i{k}" href="c/{n - k}.xhtml"/>' for k in range(n + 1))
            refs = "".join(f'<itemref idref="i{k}"/>' for k in range(n)) + f'<itemref idref="i{n}" linear="no"/>'
            z.writestr("OPS/b.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{refs}</spine></package>')
            for k in range(n + 1):
                z.writestr(f"OPS/c/{n - k}.xhtml", htmls[k] if k < n else "<p>not in the order</p>")
        return out.getvalue()

    return pages.map(one)


def epub_pages(spark, d):
    """Five pages are one book; every second book leaves out its second chapter, and each what lies from the second paragraph of its first chapter to the fourth, and the title of its third."""
    pages = load(spark, d, "pages").select("page_id", F.floor(F.col("page_id") / 5).alias("book"), "html")
    books = pages.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("page_id", "html"))).alias("ps"))
    files = books.select(
        F.concat(F.col("book").cast("string"), F.lit(".epub")).alias("path"),
        _packed(F.transform("ps", lambda p: p["html"])).alias("content"),
        F.when(F.col("book") % 2 == 1, "1").alias("skip_chapters"),
        F.lit("body/div[1]/html:article/p[2] ; body/div[1]/article/p[4],.//html:body/div[2]/article/h1;").alias("skip_elements"),
    )
    each = R.documents(files).select("path", "error", F.posexplode("paragraphs").alias("k", "p"))
    return each.select("path", "error", (F.col("k") + 1).alias("para_no"), "p.type", "p.text")


QUERIES = {f.__name__: f for f in (reader_dispatch, mixed_files, epub_pages)}

_KEPT_SQL = f"regexp_replace(coalesce(text, ''), '{_KEPT}', '', 'g')"
_PLAIN = _islands(f"(select doc_id, {_KEPT_SQL} as text from documents where doc_id % 10 < 3)", "doc_id")
_READERS = ", ".join(f"({k}, {quoted(r) if r else 'null'})" for k, (_, r) in enumerate(_PATHS))

ORACLE = {
    "reader_dispatch": f"select doc_id, case when m = 1 and doc_id % 5 = 0 then 'ocr' else reader end as reader from documents join (values {_READERS}) as t(m, reader) on doc_id % {len(_PATHS)} = m",
    "mixed_files": f"""
with runs as (select * from ({_PLAIN})),
lines as (select doc_id, doc_id % 10 as kind, generate_subscripts(l, 1) as k, trim(unnest(l)) as x from (select doc_id, string_split({_KEPT_SQL}, chr(10)) as l from documents where doc_id % 10 between 3 and 7)),
spoken as (select doc_id, k, case when kind in (4, 7) then 'title' else 'text' end || ':' || trim(regexp_replace(case when kind = 4 then replace(x, '\\', '') else x end, ' +', ' ', 'g')) as s from lines where length(x) > 1
         union all select doc_id, para_no, 'text:' || text from runs),
own as (select doc_id, count(*) as n, md5(string_agg(s, chr(10) order by k)) as digest from spoken where length(s) > 6 or (length(s) > 5 and s like 'text:%') group by doc_id),
{PAGE_BLOCKS},
page as (select page_id, count(*) as n, md5(string_agg(type || ':' || text, chr(10) order by k)) as digest from plain_blocks group by page_id),
path as (select doc_id, doc_id % 10 as kind from documents)
select '/c/' || case kind when 6 then 'udhr_' when 7 then 'avvir_xml/' else '' end || doc_id || (['.txt', '.txt', '.txt', '.svg', '.sfm', '.usx', '.xml', '.xml', '.usx', '.zzz'])[kind + 1] as path,
  (['plain', 'plain', 'plain', 'svg', 'verses', 'usx', 'articles', 'newspaper', 'usx', null])[kind + 1] as reader, coalesce(n, 0) as n, coalesce(digest, md5('')) as digest, kind > 7 as failed
from path left join own using (doc_id)
union all select '/c/page' || page_id || '.html', 'html', coalesce(n, 0), coalesce(digest, md5('')), false from pages left join page using (page_id)""",
    "epub_pages": f"""
with {PAGE_BLOCKS},
numbered as (select *, page_id // 5 as book, page_id % 5 as c, sum(case when tag = '<p>' then 1 else 0 end) over (partition by page_id order by k) as p from all_blocks),
seen as (select *, dense_rank() over (partition by book order by c) as chapter from numbered where not (book % 2 = 1 and c = 1)),
kept as (select * from seen where length(text) > 1 and not (chapter = 1 and tag = '<p>' and p in (2, 3)) and not (chapter = 2 and tag = '<h1>'))
select book || '.epub' as path, cast(null as varchar) as error, cast(row_number() over (partition by book order by c, k) as int) as para_no, type, text from kept""",
}
