"""A folder of mixed files as documents: one pass from bytes to paragraphs, with a reader for each row and a column for what failed.

Text files are decoded and cut by column expressions. What has to be parsed (pages, e-books, XML) is parsed in one Arrow function, row by row;
a file that can't be read is a row with an error, never the end of a job.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.dates import number_ranges
from corpusmill.operators import html as H
from corpusmill.operators.paragraphs import clean_plain
from corpusmill.sources.formats import SFM_IGNORED, SFM_TEXT, SFM_TITLES, _bible, _usx, sfm_paragraphs

# Suffixes, and the reader of the files that have them. Readers marked `outside` need a program that turns them into a page first.
READERS = {
    ".doc": "outside", ".docx": "outside", ".epub": "epub", ".html": "html", ".odt": "outside", ".pdf": "outside", ".rtf": "outside", ".sfm": "verses",
    ".svg": "svg", ".txt": "plain", ".tex": "outside", ".writenow": "outside", ".usx": "usx",
}


def reader_of(path: Column, status: Column | None = None) -> Column:
    """Name of the reader for a file; null where there is none. Names and status come before the suffix."""
    suffix = F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)
    table = F.create_map(*(F.lit(x) for pair in READERS.items() for x in pair))
    named = F.when(F.contains(path, F.lit("avvir_xml")), "newspaper").when(F.endswith(path, F.lit("bible.xml")), "bible").when(F.contains(path, F.lit("udhr_")) & (suffix == ".xml"), "articles")
    if status is not None:
        named = named.when((status == "ocr") & (suffix == ".pdf"), "ocr")
    return named.when(F.endswith(path, F.lit(".correct.txt")), "marked errors").otherwise(F.try_element_at(table, suffix))


# ---- e-books


def _tag(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def chapters(content: bytes) -> Iterator[str]:
    """The pages of an e-book in the order of its spine."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(n.get("full-path") for n in root.iter() if _tag(n) == "rootfile")
        parts = list(ElementTree.fromstring(z.read(package)).iter())
        files = {n.get("id"): n.get("href") for n in parts if _tag(n) == "item"}
        for n in parts:
            if _tag(n) == "itemref" and n.get("linear") != "no":
                yield z.read(posixpath.join(posixpath.dirname(package), files[n.get("idref")])).decode("utf-8")


def book(content: bytes, excluded: list[int]) -> H.Node:
    """One body with a div for each chapter (counted from 0) that isn't excluded."""
    body = H.Node("body")
    for k, page in enumerate(chapters(content)):
        if k not in excluded:
            part = H.read(page)[1]
            part.tag = "div"
            body.add(part)
    return body


def _found(body: H.Node, path: str) -> H.Node | None:
    """The first node at a path of `name` or `name[k]` steps, from the page's root."""
    at = [body]
    steps = [s.strip().removeprefix("html:") for s in path.strip().lstrip("./").split("/")]
    for step in steps[steps[0] == "body" :]:
        name, _, number = step.partition("[")
        kids = [[k for k in n.kids if k.tag == name] for n in at]
        at = [k for ks in kids for k in (ks[int(number.rstrip("]")) - 1 :][:1] if number else ks)]
    return at[0] if at else None


def without_ranges(body: H.Node, ranges: str) -> H.Node:
    """Without what lies from the first path of each `path;path` (which goes) to the second (which stays); a single path is one element.

    Nodes are numbered in the page's order, so a range is an interval of numbers; it ends with the first path's parent if there is no such second node.
    Elements that hold the second path stay, as does text at their beginning.
    """
    for pair in filter(str.strip, ranges.split(",")):
        first, _, last = pair.partition(";")
        start, end = _found(body, first), _found(body, last) if last.strip() else None
        if start is None:
            continue
        number = {id(n): k for k, n in enumerate(body.all())}
        holds, up = set(), end
        while up is not None:
            holds.add(id(up))
            up = up.up
        beyond = number[id(end)] if end is not None else 1 + max(number[id(n)] for n in start.up.all()) if last.strip() else 0
        inside = range(number[id(start)], beyond)
        for n in [body, *body.all()]:
            n.kids = [k for j, k in enumerate(n.kids) if k is not start and (number[id(k)] not in inside or id(k) in holds or (not k.tag and j == 0 and id(n) in holds))]
    return body


# ---- files


def _svg(text: str) -> list[tuple[str, str]]:
    return [("text", " ".join("".join(n.itertext()).split())) for n in ElementTree.fromstring(text).iter() if _tag(n) == "text"]


# Elements of articles in XML, and what they are on a page.
_ARTICLES = {"title": "h2", "para": "p", "orderedlist": "ol", "listitem": "li"}


def _articles(text: str) -> list[tuple[str, str]]:
    """Titles, paragraphs and lists of articles; the preamble's title isn't shown."""

    def page(node: ElementTree.Element, above: str) -> str:
        name = _tag(node)
        inner = H.escaped(node.text) + "".join(page(k, name) + H.escaped(k.tail) for k in node)
        tag = _ARTICLES.get(name)
        return "" if name == "title" and above == "preamble" else f"<{tag}>{inner}</{tag}>" if tag else inner

    return [p[:2] for p in H.page_paragraphs(f"<body>{page(ElementTree.fromstring(text), '')}</body>")[1]]


def _stories(text: str) -> list[tuple[str, str]]:
    """Paragraphs of newspaper stories; of repeated ids the first story counts. Pieces inside a paragraph are paragraphs of their own, but for a paragraph in a paragraph, which an editor has taken out."""
    out, seen = [], set()
    for story in ElementTree.fromstring(text.replace("‹‹", "«").replace("››", "»")).iter("story"):
        if story.get("id") is not None and story.get("id") in seen:
            continue
        seen.add(story.get("id"))
        kind = "title" if story.get("class") in ("Tittel", "Undertittel") else "text"
        for p in story.findall("p"):
            pieces = [p.text or ""]
            for kid in p:
                if kid.tag == "p":
                    pieces[-1] += kid.tail or ""
                else:
                    pieces += [kid.text or "", *(t or "" for k in kid for t in (k.text, k.tail)), kid.tail or ""]
            out += [(kind, " ".join(t.split())) for t in pieces]
    return out


def _parsed(reader: str, text: str, content: bytes, excluded: list[int], ranges: str) -> tuple[str, list[tuple[str, str]]]:
    if reader == "html":
        title, found = H.page_paragraphs(text)
        return title, [p[:2] for p in found]
    if reader == "epub":
        return "", [p[:2] for p in H.body_paragraphs(without_ranges(book(content, excluded), ranges))]
    parse: dict[str, Callable[[str], Any]] = {
        "usx": lambda t: [(k, x) for _, k, x in _usx(ElementTree.fromstring(t))],
        "bible": lambda t: [(k, x) for _, k, x in _bible(ElementTree.fromstring(t))],
        "svg": _svg, "articles": _articles, "newspaper": _stories,
    }
    if reader not in parse:
        raise ValueError("needs a program from outside" if reader in ("outside", "ocr") else f"read it with the {reader} reader")
    return "", [(k, x) for k, x in parse[reader](text) if x]


_PARSED = "title string, paragraphs array<struct<type:string,text:string>>, error string"


def plain_paragraphs(text: Column) -> Column:
    """Runs of lines without a blank one between, as an array."""
    gap = X.WS.replace("\t-\r", "\t\x0b-\r")  # white space but the line break
    emptied = F.regexp_replace(F.concat(F.lit("\n"), clean_plain(text), F.lit("\n")), f"(?md)^{gap}+$", "")
    return F.filter(F.transform(F.split(emptied, "\n\n+"), lambda p: F.regexp_replace(p, "^\n+|\n+$", "")), lambda p: p != "")


def documents(files: DataFrame) -> DataFrame:
    """path, reader, title, paragraphs (type, text), error of files (path, content as bytes, and perhaps status, skip_chapters, skip_elements).

    Each file is one row. A file without a reader, or that its reader can't read, has an error and no paragraphs.
    """
    has = lambda c: F.col(c) if c in files.columns else F.lit(None).cast("string")

    @F.pandas_udf(_PARSED)
    def parsed(reader: pd.Series, text: pd.Series, content: pd.Series, excluded: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = []
        for name, t, b, out, pairs in zip(reader, text, content, excluded, ranges, strict=True):
            try:
                title, found = _parsed(name, t, b, list(out), pairs) if name else ("", [])
                rows.append((title, [{"type": k, "text": x} for k, x in found], None))
            except Exception as e:  # a bad file is a row, whatever is wrong with it
                rows.append(("", [], f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["title", "paragraphs", "error"])

    rows = files.select("path", "content", has("status").alias("status"), F.coalesce(has("skip_chapters"), F.lit("")).alias("chapters"), F.coalesce(has("skip_elements"), F.lit("")).alias("ranges"))
    rows = rows.withColumn("reader", reader_of(F.col("path"), F.col("status"))).withColumn("text", H.decoded(F.col("content")))
    in_row = F.col("reader").isin("plain", "marked errors")
    ask = lambda c: F.when(~in_row, F.col(c))  # noqa: E731  what isn't parsed doesn't travel
    rows = rows.withColumn("p", parsed(ask("reader"), ask("text"), F.when(F.col("reader") == "epub", F.col("content")), number_ranges(F.col("chapters")), F.col("ranges")))
    plain = F.transform(plain_paragraphs(F.col("text")), lambda t: F.struct(F.lit("text").alias("type"), t.alias("text")))
    error = F.when(F.col("reader").isNull(), F.lit("no reader for such files")).otherwise(F.col("p.error"))
    done = rows.where("reader is distinct from 'verses'")
    done = done.select("path", "reader", F.col("p.title").alias("title"), F.when(in_row, plain).otherwise(F.col("p.paragraphs")).alias("paragraphs"), error.alias("error"))
    return done.union(_verses(rows.where("reader = 'verses'")))


def _verses(rows: DataFrame) -> DataFrame:
    """Files of marked-up verses: their paragraphs are islands of lines. A file with an unknown marker has an error."""
    lines = rows.select("path", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    marker = F.regexp_extract("line", r"^\\(\w+)", 1)
    bad = lines.where((marker != "c") & ~marker.isin(*SFM_TITLES, *SFM_TEXT, *SFM_IGNORED, "s2")).groupBy("path").agg(F.concat(F.lit("unknown marker "), F.min(marker)).alias("error"))
    good = sfm_paragraphs(lines, "path", strict=False).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("para_no", "type", "text"))).alias("ps"))
    said = F.transform(F.coalesce(F.when(F.col("error").isNull(), F.col("ps")), F.array().cast("array<struct<para_no:int,type:string,text:string>>")), lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text")))
    return rows.join(good, "path", "left").join(bad, "path", "left").select("path", "reader", F.lit("").alias("title"), said.alias("paragraphs"), "error")


def folder(spark: SparkSession, root: str) -> DataFrame:
    """documents() of all files below a folder. Spark doesn't list files without a byte."""
    return documents(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content"))
