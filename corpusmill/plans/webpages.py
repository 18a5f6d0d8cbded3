"""Queries on web pages: conversion to paragraphs by the element map, and documents dressed as pages by a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import html as H
from corpusmill.operators import printed as V
from corpusmill.sources.tables import load


def _paragraphs(found, key):
    each = found.select(key, "title", F.posexplode("paragraphs").alias("k", "p"))
    spans = F.array_join(F.transform("p.spans", lambda s: F.concat_ws(":", s["type"], s["text"])), "|")
    return each.select(key, "title", (F.col("k") + 1).alias("para_no"), "p.type", "p.text", spans.alias("spans"))


def html_extract(spark, d):
    return _paragraphs(H.extract(load(spark, d, "pages")), "page_id")


#: How lines of documents are dressed, line by line in turn ($ is the line), and the paragraphs that come of it: (type, text, span).
_DRESS = [
    ("<h3>$</h3>", [("title", "$", "")]),
    ("<p>$</p>", [("text", "$", "")]),
    ("<div>$<b>$</b></div>", [("text", "$", ""), ("text", "$", "bold")]),
    ("<ul><li>$<li><div><p>$</p></div></ul>", [("listitem", "$", ""), ("listitem", "$", "")]),
    ("<table><tr><td><a href=x>$</a><th>$<tr><td><span>$</span></table>", [("text", "$", "")] * 3),
    ('<div class="sidebar"><p>$</p></div>$<p>$</p>', [("text", "$", "")]),
    ("<div><figure>$</figure>$</div>", [("text", "$", "")]),
    ("<blockquote><p>$</p></blockquote>", [("text", "$", "quote")]),
    ("<dl><dt>$<dd>$</dl>", [("text", "$", ""), ("text", "$", "")]),
    ("<p><i>$</i></p>", [("text", "$", "italic")]),
    ("<p><i>$<b>$</b></i></p>", [("text", "$ $", "")]),
    ("<center>$</center>", [("text", "$", "")]),
    ("<p>• $ •$</p>", [("listitem", "$", ""), ("listitem", "$", "")]),
    ("<p><font size=1>$</font></p>", [("text", "$", "")]),
    ('<p><script>var x = "</p>"; $</script>$</p><p>$</p>', [("text", "$", "")]),
    ("<ul><li>$</li>$</ul>", [("listitem", "$", "")]),
    ("<pre>$</pre>", [("pre", "$", "")]),
    ("<p>$<sup>$</sup></p>", [("text", "$ $", "")]),
    ("<div><x-tag>$</x-tag><!-- $ --></div>", [("text", "$", "")]),
    ("<em>$</em>", [("text", "$", "italic")]),
    ("<div id=footer>$</div>$<h2>$</h2>", [("title", "$", "")]),
    ("<div><em><p>$</p></em><u>$</u></div>", [("text", "$", ""), ("text", "$", "bold")]),
    ("<ul><li><p><i>$</i></p></ul>", [("listitem", "$", "em")]),
    ("<section><header>$</header><nav><p>$</p></nav><strong>$</strong></section>", [("text", "$", ""), ("text", "$", "bold")]),
    ("<table><caption>$</caption><tr><td><form><input value=x>$</form></table>", [("text", "$", ""), ("text", "$", "")]),
]
_GAPS = X.WS.removesuffix("]") + "<>&•$]+"


def html_dressed(spark, d):
    """Documents as web pages: every line in an element, in turn; each rule that is used has its rows in the SQL."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "l"))
    lines = lines.select("doc_id", "k", F.trim(F.regexp_replace("l", _GAPS, " ")).alias("l")).where("length(l) > 1")
    dress = F.element_at(F.array(*(F.lit(h) for h, _ in _DRESS)), F.col("k") % len(_DRESS) + 1)
    pages = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", F.replace(dress, F.lit("$"), F.col("l")).alias("h")))).alias("ls"))
    html = F.concat(F.lit("<html><head><title>Page "), F.col("doc_id").cast("string"), F.lit("</title></head><body>\n"), F.array_join(F.transform("ls", lambda x: x["h"]), "\n"), F.lit("\n</body></html>"))
    return _paragraphs(H.extract(pages.select("doc_id", html.alias("html")), "doc_id"), "doc_id").drop("title")


#: Margins in percent: document's id modulo 4, then side, page or kind of pages, value.
_MARGINS = [
    (0, "left_margin", "all", 10.0), (0, "left_margin", "2", 37.5), (0, "top_margin", "odd", 12.5), (0, "top_margin", "even", 5.0), (1, "right_margin", "3", 50.0), (1, "right_margin", "all", 20.0), (1, "right_margin", "odd", 90.0),
    (1, "bottom_margin", "even", 33.0), (2, "inner_left_margin", "all", 25.0), (2, "inner_right_margin", "all", 25.0), (2, "inner_top_margin", "1", 10.0), (2, "left_margin", "odd", 1.0),
]


def printed_lines(spark, d):
    """Lines of documents as pieces of printed pages, five a page, where a rule puts them: those inside the margins."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))
    pieces = lines.select("doc_id", "k", (F.floor(F.col("k") / 5) + 1).cast("int").alias("page"), ((F.length("line") * 37 + F.col("k") * 11) % 600).alias("left"), ((F.length("line") * 53 + F.col("k") * 7) % 800).alias("top"), F.lit(600).alias("width"), F.lit(800).alias("height"))
    sides = {}
    for m, side, key, value in _MARGINS:
        sides.setdefault(m, {}).setdefault(side, {})[key] = value
    table = spark.createDataFrame([(m, own) for m, own in sides.items()], "m int, margins map<string,map<string,double>>")
    placed = pieces.withColumn("m", (F.col("doc_id") % 4).cast("int")).join(F.broadcast(table), "m", "left")
    empty = F.create_map().cast("map<string,map<string,double>>")
    return V.inside(placed.withColumn("margins", F.coalesce("margins", empty))).select("doc_id", "k", "page", "left", "top")


QUERIES = {f.__name__: f for f in (html_extract, html_dressed, printed_lines)}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SAID = ", ".join(f"({k}, {j}, {quoted(kind)}, {quoted(text)}, {quoted(span)})" for k, (_, said) in enumerate(_DRESS) for j, (kind, text, span) in enumerate(said))

#: SQL of the blocks of an article (all_blocks), and of those with text (plain_blocks).
PAGE_BLOCKS = f"""art as (select page_id, regexp_extract(html, '<title>(.*?)</title>', 1) as title, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as body from pages),
blocks as (select page_id, title, unnest(string_split_regex(body, '<h1>|<p>')) as b, generate_subscripts(string_split_regex(body, '<h1>|<p>'), 1) as k,
           unnest(list_concat([''], regexp_extract_all(body, '<h1>|<p>'))) as tag from art),
said as (select *, trim(regexp_replace(regexp_replace(b, '</?[a-z0-9]+>|<br>', '', 'g'), '{X.WS}+', ' ', 'g')) as raw from blocks),
all_blocks as (select page_id, replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as title, k, tag, b,
          replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as text, case when tag = '<h1>' then 'title' else 'text' end as type from said),
plain_blocks as (select * from all_blocks where length(text) > 1)"""



def _share(side: str) -> str:
    """SQL of a margin in percent: page, all, even or odd, none."""
    find = lambda test: f"(select max(value) from margins where m = doc_id % 4 and side = '{side}' and {test})"
    return f"coalesce({find('name = page::varchar')}, {find(chr(110) + 'ame = ' + quoted('all'))}, {find('name = case when page % 2 = 0 then ' + quoted('even') + ' else ' + quoted('odd') + ' end')}, 0.0)"


_IN = '"left" > trunc({p}left * 6.0) and "left" < trunc(600 - {p}right * 6.0) and top > trunc({p}top * 8.0) and top < trunc(800 - {p}bottom * 8.0)'
ORACLE = {
    "printed_lines": f"""
with margins as (select * from (values {", ".join(f"({m}, {quoted(side)}, {quoted(key)}, {value}::double)" for m, side, key, value in _MARGINS)}) as t(m, side, name, value)),
lines as (select doc_id, generate_subscripts(x, 1) - 1 as k, unnest(x) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
pieces as (select doc_id, cast(k as int) as k, cast(k // 5 + 1 as int) as page, cast((length(line) * 37 + k * 11) % 600 as int) as "left", cast((length(line) * 53 + k * 7) % 800 as int) as top from lines),
shares as (select *, {", ".join(f"{_share(prefix + side + '_margin')} as {short}{side}" for prefix, short in (("", "o"), ("inner_", "i")) for side in ("left", "right", "top", "bottom"))} from pieces)
select doc_id, k, page, "left", top from shares where {_IN.format(p="o")} and not (ileft + iright + itop + ibottom > 0 and {_IN.format(p="i")})""",
    "html_extract": f"""
with {PAGE_BLOCKS}
select page_id, trim(regexp_replace(title, '{X.WS}+', ' ', 'g')) as title, cast(row_number() over (partition by page_id order by k) as int) as para_no,
       type, text, case when b like '<b>%' then 'bold:' || text else '' end as spans
from plain_blocks""",
    "html_dressed": f"""
with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as k from documents),
own as (select doc_id, k, trim(regexp_replace(l, '{_GAPS}', ' ', 'g')) as l from lines),
said as (select * from (values {_SAID}) as t(m, j, type, text, span))
select doc_id, cast(row_number() over (partition by doc_id order by k, j) as int) as para_no, type, replace(said.text, '$', l) as text,
       case when span = '' then '' else span || ':' || replace(said.text, '$', l) end as spans
from own join said on k % {len(_DRESS)} = m where length(l) > 1""",
}
