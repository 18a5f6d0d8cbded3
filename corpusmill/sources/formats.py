"""Readers and writers of the corpus formats: token tables as text, translation memories, verse files, newspaper stories."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators.numbering import numbered

TOKEN_COLUMNS = ("word", "lemma", "pos", "msd", "ref", "deprel", "dephead")


def _vrt_sentence(number: Column, n: Column, body: Column) -> Column:
    return F.format_string('<sentence id="%d" token_count="%d">\n%s\n</sentence>', number, n, body)


def _vrt_text(about: list[str], sentences: Column, tokens: Column, body: Column) -> Column:
    own = F.concat(*(F.format_string(f' {c}="%s"', F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in about)) if about else F.lit("")
    return F.format_string('<text id="%s"%s sentence_count="%d" token_count="%d">\n%s\n</text>', F.col("text_id").cast("string"), own, sentences, tokens, body).alias("vrt")


def vrt_texts(tokens: DataFrame, attributes: DataFrame) -> DataFrame:
    """text_id, vrt: one text element per document with its sentences and seven-column lines. Texts are built where their tokens are grouped."""
    line = F.concat_ws("\t", *TOKEN_COLUMNS)
    sents = tokens.groupBy("text_id", "sentence_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"), F.count("*").alias("n"))
    element = _vrt_sentence(F.col("sentence_id"), F.col("n"), F.col("body"))
    texts = sents.groupBy("text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_id", element.alias("e")))), lambda x: x["e"]), "\n").alias("body"), F.count("*").alias("sentences"), F.sum("n").alias("tokens"))
    return texts.join(attributes, "text_id").select("text_id", _vrt_text([c for c in attributes.columns if c != "text_id"], F.col("sentences"), F.col("tokens"), F.col("body")))


def vrt_of(texts: DataFrame, about: tuple[str, ...]) -> DataFrame:
    """text_id, vrt as vrt_texts() gives them, of texts that hold their tokens: text_id, attributes, sentences (in order, each the TOKEN_COLUMNS of its tokens). Each row is one text, and nothing is grouped or joined."""
    line = lambda t: F.concat_ws("\t", *(t[c] for c in TOKEN_COLUMNS))
    body = F.transform("sentences", lambda s, k: _vrt_sentence(k + 1, F.size(s), F.array_join(F.transform(s, line), "\n")))
    n = F.aggregate("sentences", F.lit(0), lambda a, s: a + F.size(s))
    return texts.where("size(sentences) > 0").select("text_id", _vrt_text(list(about), F.size("sentences"), n, F.array_join(body, "\n")))


def vrt_tokens(texts: DataFrame, key: str = "text_id", column: str = "vrt") -> DataFrame:
    """key, sentence_id, position and the seven columns; lines of another width are left out."""
    sent = texts.select(key, F.posexplode(F.regexp_extract_all(column, F.lit(r'(?s)<sentence id="\d+"[^>]*>\n(.*?)\n</sentence>'), F.lit(1))).alias("s", "body"))
    lines = sent.select(key, (F.col("s") + 1).alias("sentence_id"), F.posexplode(F.split("body", "\n")).alias("p", "line"))
    parts = F.split("line", "\t")
    return lines.where(F.size(parts) == 7).select(key, "sentence_id", (F.col("p") + 1).alias("position"), *(parts[k].alias(c) for k, c in enumerate(TOKEN_COLUMNS)))


def bad_vrt_lines(texts: DataFrame, key: str = "text_id", column: str = "vrt") -> DataFrame:
    """key, line: token lines that don't have seven columns."""
    lines = texts.select(key, F.explode(F.split(column, "\n")).alias("line")).where("line <> '' and not startswith(line, '<')")
    return lines.where(F.size(F.split("line", "\t")) != 7)


_LANG = "{http://www.w3.org/XML/1998/namespace}lang"


def tmx_units(files: DataFrame, key: str, column: str) -> DataFrame:
    """key, tu_no, src_lang, src_text, tgt_lang, tgt_text of translation memories; one that can't be parsed gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, xml in zip(b[key], b[column], strict=True):
                try:
                    root = ElementTree.fromstring((xml or "").encode())
                except ElementTree.ParseError:
                    continue
                for n, tu in enumerate(root.iter("tu"), 1):
                    sides = [(t.get(_LANG) or t.get("lang") or "", "".join(t.find("seg").itertext()) if t.find("seg") is not None else "") for t in tu.iter("tuv")]
                    if len(sides) == 2:
                        rows.append((k, n, *sides[0], *sides[1]))
            yield pd.DataFrame(rows, columns=[key, "tu_no", "src_lang", "src_text", "tgt_lang", "tgt_text"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, column).mapInPandas(run, f"{key} {kind}, tu_no int, src_lang string, src_text string, tgt_lang string, tgt_text string")


# Markers of verse files that stand for a title, for running text, and those left out; s2 is a chapter's summary.
SFM_TITLES, SFM_TEXT, SFM_IGNORED = ("mt1", "mt2", "s1"), ("p", "m", "v", ""), ("id", "ide", "h", "toc1", "toc2", "toc3", "cp")


def sfm_paragraphs(lines: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """key, section, para_no, type, text of marked-up verse lines (line_no, line).

    A chapter begins a section; a title or summary is a paragraph and ends the one before. All other lines up to the next such line are one
    paragraph, a line each. Notes and verse numbers go, empty paragraphs too; an unknown marker is an error, or, unless strict, its line goes.
    """
    bare = F.regexp_replace("line", r"\\(f|x|vp)\b[\s\S]*?\\\1\*", "")
    marker = F.regexp_extract(bare, r"^\\(\w+)", 1)
    body = X.carons(F.regexp_replace(bare, r"^\\\w+\s*", ""))
    body = F.when(marker == "v", F.regexp_replace(body, r"^[0-9]+[-0-9]*\s*", "")).when(marker != "c", body)
    kind = F.when(marker.isin(*SFM_TITLES), "title").when(marker == "s2", "summary").when(marker.isin(*SFM_TEXT), "text").when(marker == "c", "section").when(marker.isin(*SFM_IGNORED), "none").otherwise(F.raise_error(F.concat(F.lit("unknown marker "), marker)).cast("string") if strict else F.lit("none"))
    w = Window.partitionBy(key).orderBy("line_no")
    rows = lines.select(key, "line_no", kind.alias("kind"), body.alias("body")).where("kind <> 'none'")
    rows = rows.withColumn("section", F.sum((F.col("kind") == "section").cast("int")).over(w)).withColumn("ends", F.sum((F.col("kind") != "text").cast("int")).over(w)).where("body <> ''")
    one = rows.groupBy(key, "section", "ends", (F.col("kind") == "text").alias("running")).agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("line_no", "body"))).alias("ls"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("ends", "running"))
    return one.select(key, "section", number.alias("para_no"), F.when(F.col("kind") == "title", "title").otherwise("text").alias("type"), F.array_join(F.transform("ls", lambda x: x["body"]), "\n").alias("text"))


def verse_number(identifier: Column) -> Column:
    """The last dotted part of a verse's identifier."""
    return F.element_at(F.split(identifier, r"\."), -1)


# Paragraph styles of scripture XML: those that begin a paragraph, titles among them, those that go on with one, and list items. Others are left out.
USX_BEGIN, USX_TITLE, USX_GO_ON, USX_LIST = ("s", "p", "nb", "mt", "mt1", "ms", "sp", "ip"), ("s", "mt", "ms", "mt1"), ("m", "q", "q1", "q2", "pi"), ("li", "li1", "li2")


def _running(para: ElementTree.Element) -> str:
    """Text of a paragraph without notes, with single blanks."""
    parts = [para.text or ""]
    for child in para:
        parts += ["" if child.tag == "note" else _running(child), child.tail or ""]
    return " ".join("".join(parts).split())


def _usx(root: ElementTree.Element) -> Iterator[tuple[int, str, str]]:
    section, paras = 0, []
    for node in root:
        style = node.get("style")
        section += node.tag == "chapter"
        if node.tag != "para":
            continue
        text = _running(node)
        if style in USX_GO_ON and paras and paras[-1][0] == section and paras[-1][1] != "title":
            paras[-1][2] = f"{paras[-1][2]} {text}".strip()
        elif style in USX_BEGIN + USX_GO_ON:
            paras.append([section, "title" if style in USX_TITLE else "text", text])
        elif style in USX_LIST:
            paras.append([section, "listitem", text])
    yield from map(tuple, paras)


def _bible(root: ElementTree.Element) -> Iterator[tuple[int, str, str]]:
    def verses(nodes) -> str:
        return "\n".join(v.text for v in nodes if v.text)

    def section(node):
        yield "title", node.get("title") or ""
        loose = []
        for child in node:
            if child.tag == "p":
                if loose:
                    yield "text", verses(loose)
                    loose = []
                yield "text", verses(child)
            else:
                loose.append(child)
        yield "text", verses(loose)

    number = 0
    for book in root.iter("book"):
        yield number, "title", book.get("title") or ""
        for chapter in book.iter("chapter"):
            number += 1
            yield number, "title", " ".join(x for x in (chapter.get("number"), chapter.get("title")) if x is not None)
            for child in chapter:
                yield from ((number, *p) for p in (section(child) if child.tag == "section" else [("text", child.text or "")]))


def scripture_paragraphs(docs: DataFrame, key: str, xml: str, usx: bool) -> DataFrame:
    """key, section (chapters from 1, 0 before them), para_no, type, text of scripture XML: paragraphs by style (usx), or books, chapters, sections and verses. Empty paragraphs and files that aren't XML give no rows."""
    read = _usx if usx else _bible

    @F.pandas_udf("array<struct<section:int,type:string,text:string>>")
    def paras(column: pd.Series) -> pd.Series:
        def one(x):
            try:
                return [p for p in read(ElementTree.fromstring(x)) if p[2]]
            except (ElementTree.ParseError, TypeError):
                return None

        return column.map(one)

    return docs.select(key, F.posexplode(paras(xml)).alias("k", "p")).select(key, "p.section", (F.col("k") + 1).alias("para_no"), "p.type", "p.text")


def first_stories(stories: DataFrame, key: str, order: str) -> DataFrame:
    """Newspaper stories without repeats of an id; the first one counts."""
    names = [c for c in stories.columns if c != key]
    return stories.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("s")).select(key, "s.*")


def model_lines(model: DataFrame, word_model: bool = False) -> DataFrame:
    """lang, rank, value: lines of model files, most frequent first."""
    pair = (F.col("freq").cast("string"), F.col("gram")) if word_model else (F.col("gram"), F.col("freq").cast("string"))
    return model.select("lang", "rank", F.concat_ws("\t", *pair).alias("value"))


def anchor_lines(anchors: DataFrame) -> DataFrame:
    return anchors.select(F.concat_ws(" / ", "w1", "w2").alias("value"))


def corpus_facts(texts: DataFrame) -> DataFrame:
    """genre, sentences, first, last: what a corpus's info file says; only real dates count."""
    day = F.try_to_timestamp("datefrom", F.lit("yyyyMMdd")).cast("date")
    return texts.groupBy("genre").agg(F.sum("sentences").alias("sentences"), F.min(day).alias("first"), F.max(day).alias("last"))


def registry(name: Column, info: Column) -> Column:
    """Head of a corpus registry file."""
    return F.format_string("NAME \"%s\"\nID %s\nHOME %s\nINFO %s\nATTRIBUTE " + "\nATTRIBUTE ".join(TOKEN_COLUMNS) + "\n", name, F.lower(name), F.lower(name), info)


def package_ids(files: DataFrame, order: str) -> DataFrame:
    """Adds package_id: the running number of a packaged file, of six digits at least."""
    number = F.col("__k").cast("string")
    return numbered(files, [order], column="__k").withColumn("package_id", F.lpad(number, F.greatest(F.lit(6), F.length(number)), F.lit("0"))).drop("__k")


def sentence_links(units: DataFrame) -> DataFrame:
    """file, link_id and sentence ids of aligned sentences."""
    return units.select("file", F.format_string("l%d", F.col("tu_no")).alias("link_id"), F.format_string("l%ds%d", F.col("tu_no"), F.col("tu_no")).alias("sentence_id"), "src_text", "tgt_text")
