"""Lines to paragraphs and tokens to sentences, as islands inside each document; cleaning of plain text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill import storage
from corpusmill.functions import text as X

# Marks of old word processors in plain text.
PLAIN_TEXT_MARKS = [
    ("ÊÊ", "\n"), (r"<\!q>", ""), (r"<\!h>", ""), ("<*B>", ""), ("<*P>", ""), ("<*I>", ""), ("\r", "\n"), ("<ASCII-MAC>", ""), ("<vsn:3.000000>", ""),
    ("<0x010C>", "Č"), ("<0x010D>", "č"), ("<0x0110>", "Đ"), ("<0x0111>", "đ"), ("<0x014A>", "Ŋ"), ("<0x014B>", "ŋ"), ("<0x0160>", "Š"), ("<0x0161>", "š"),
    ("<0x0166>", "Ŧ"), ("<0x0167>", "ŧ"), ("<0x017D>", "Ž"), ("<0x017E>", "ž"), ("<0x2003>", " "), ("=" * 80, "\n"),
]
# Tokens that end a sentence.
STOPS = (";", "!", "?", ".", "..", "...", "¶", "…")


def clean_plain(text: Column) -> Column:
    """Unified line ends, then marks of old word processors and control characters removed."""
    return X.strip_controls(X.replace_all(F.replace(text, F.lit("\r\n"), F.lit("\n")), PLAIN_TEXT_MARKS))


def lines(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, line_no (from 1), line."""
    return docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("k", "line")).select(*keys, (F.col("k") + 1).alias("line_no"), "line")


def skip_lines(rows: DataFrame, skipped: Column) -> DataFrame:
    """Without the numbered lines; those that start with # stay."""
    return rows.where(~F.array_contains(skipped, F.col("line_no")) | F.startswith("line", F.lit("#")))


def paragraphs(rows: DataFrame, key: str) -> DataFrame:
    """key, para_no (from 1), text: runs of lines without a blank one between."""
    w = Window.partitionBy(key).orderBy("line_no")
    blank = F.regexp_like("line", F.lit("^" + X.WS + "*$"))
    marked = rows.withColumn("blank", blank).withColumn("island", F.sum(F.col("blank").cast("int")).over(w)).where("not blank")
    joined = marked.groupBy(key, "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return joined.select(key, F.row_number().over(Window.partitionBy(key).orderBy("island")).alias("para_no"), "text")


def tokens(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos, token: words, single stop marks, runs of dots and runs of white space, in order."""
    pattern = rf"\.+|[;!?¶…]|{X.WS}+|[^;!?.¶…\t-\r\x1c-\x1f \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+"
    return docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("pos", "token"))


def sentences(toks: DataFrame, key: str) -> DataFrame:
    """key, sentence_no, sentence: tokens up to and with a stop; the pilcrow itself isn't shown; white space is normalised and empty sentences go."""
    w = Window.partitionBy(key).orderBy("pos")
    stop = F.col("token").isin(*STOPS)
    before = F.coalesce(F.sum(stop.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = F.when(F.col("token") == "¶", "").otherwise(F.col("token"))
    joined = toks.withColumn("island", before).groupBy(key, "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("t")))), lambda x: x["t"]), "").alias("raw"))
    clean = joined.select(key, "island", F.array_join(X.pieces("raw"), " ").alias("sentence")).where("sentence <> ''")
    return clean.select(key, F.row_number().over(Window.partitionBy(key).orderBy("island")).alias("sentence_no"), "sentence")


# Opening and closing quotation marks; straight and right-hand ones mustn't touch these characters inside.
QUOTES = [('"', '"', True), ("«", "»", False), ("“", "”", False), ("”", "”", True)]


def quote_pattern(opening: str, closing: str, tight: bool) -> str:
    inner = r"[^:,!?.\t-\r ]"
    return f"{opening}{inner}.+?{inner}{closing}" if tight else f"{opening}.+?{closing}"


def quotes(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, quote: every quoted span of each of the four kinds."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(quote_pattern(*q)), F.lit(0)) for q in QUOTES))
    return docs.select(key, F.explode(found).alias("quote"))


def marked_quotes(text: Column) -> Column:
    """Text with an element around every quoted span. Spans of different kinds may overlap; each is written whole, in the order of their starts."""
    patterns = [re.compile(quote_pattern(*q)) for q in QUOTES]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            spans = sorted(m.span() for p in patterns for m in p.finditer(t))
            ends = [*(a for a, _ in spans), len(t)]
            return t[: ends[0]] + "".join(f'<span type="quote">{t[a:b]}</span>{t[b:n]}' for (a, b), n in zip(spans, ends[1:], strict=True))

        return s.map(one, na_action="ignore")

    return run(text)


def compact_emphasis(runs: Column) -> Column:
    """Runs (tag, text, tail) of a paragraph with neighbouring emphases as one, if no word stands between; a paragraph with a single emphasis stays as it is."""
    t = "struct<tag:string,text:string,tail:string>"
    words = lambda r: F.coalesce(F.regexp_like(r["tail"], F.lit(r"(?U)\w")), F.lit(False))
    later = F.zip_with(runs, F.array_append(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.lit(None).cast(t)), lambda a, b: F.struct(a.alias("r"), ((a["tag"] == "em") & F.coalesce(b["tag"] == "em", F.lit(False)) & ~words(a)).alias("joins")))
    start = F.struct(F.array().cast(f"array<{t}>").alias("done"), F.array().cast("array<string>").alias("open"))

    def step(s: Column, x: Column) -> Column:
        r = x["r"]
        held = F.when(r["text"].isNull(), s["open"]).otherwise(F.array_append(s["open"], X.strip(r["text"])))
        whole = F.struct(r["tag"].alias("tag"), F.array_join(held, " ").alias("text"), F.concat(F.lit(" "), r["tail"]).alias("tail"))
        none = F.array().cast("array<string>")
        return (
            F.when(r["tag"] != "em", F.struct(F.array_append(s["done"], r.cast(t)).alias("done"), s["open"].alias("open")))
            .when(x["joins"], F.struct(s["done"].alias("done"), held.alias("open")))
            .otherwise(F.struct(F.array_append(s["done"], whole.cast(t)).alias("done"), none.alias("open")))
        )

    return F.when(F.size(F.filter(runs, lambda r: r["tag"] == "em")) > 1, F.aggregate(later, start, step, lambda s: s["done"])).otherwise(runs)


# Tags at the head of lines in old newspaper files, in the order in which they are tried, and their flags.
NEWS_TAGS = (
    (
        "text",
        r"(@*logo:|[\s+\']*@*\s*ingres+[\.:]*|.*@*.*bilde\s*\d*:|\W*(@|LED|bilde)*tekst:|@*foto:|@fotobyline:|@*bildetitt:|"
        r"<pstyle:bilde>|<pstyle:ingress>|<pstyle:tekst>|@*Samleingress:*|tekst/ingress:|billedtekst:|.@tekst:)",
        "ignore case",
    ),
    ("byline", r"(<pstyle:|\s*@*)[Bb]yline[:>]*\s*(\S+:)*", "ignore case"),
    ("bold", r"@bold\s*:", ""),
    ("italic", r"@kursiv:", ""),
    ("headertitle", r"(\s*@*(led)*tittel:|\s*@*titt(\s\d)*:|@LEDtitt:|<pstyle:tittel>|@*(hoved|over)titt(el)*:)", "ignore case"),
    (
        "title",
        r"\s*@m.titt[\.:]|\s*@*stikk:|Mellomtittel:|@*(stikk\.*|under)titt(el)*:|@ttt:|\s*@*[utm]*[:\.]*tit+:|<pstyle:m.titt>|undertittel:",
        "ignore case",
    ),
)


def _tag_pattern(pattern: str, flags: str) -> str:
    """With classes that hold all of Unicode."""
    return f"(?U{'iu' if flags else ''})(?:{pattern})"


def news_tag(line: Column) -> Column:
    """Kind of the tag that a line begins with, or null."""
    return F.coalesce(*(F.when(F.regexp_like(line, F.lit("\\A" + _tag_pattern(p, f))), kind) for kind, p, f in NEWS_TAGS))


def without_news_tag(line: Column) -> Column:
    """The line without any tag of the kind that it begins with."""
    kind, out = news_tag(line), line
    for name, p, f in NEWS_TAGS:
        out = F.when(kind == name, F.regexp_replace(line, _tag_pattern(p, f), "")).otherwise(out)
    return F.trim(out)


def page_join(previous: Column, current: Column) -> Column:
    """Text over a page break: a line-end hyphen between letters goes if a small letter follows; other hyphens stay; else a space."""
    hyphen = F.regexp_like(previous, F.lit(r"[\p{L}]-$"))
    return F.when(hyphen & F.regexp_like(current, F.lit(r"^\p{Ll}")), F.concat(F.regexp_replace(previous, "-$", ""), current)).when(F.endswith(previous, F.lit("-")), F.concat(previous, current)).otherwise(F.concat(previous, F.lit(" "), current))


def without_quotes(text: Column) -> Column:
    """Text without quoted spans that something follows; a quote at the very end stays."""
    out = text
    for q in QUOTES:
        out = F.regexp_replace(out, quote_pattern(*q) + "(.)", "$1")
    return out


def labelled(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, para_no, label: language of each line of its documents where it isn't the document's own; lines without a letter have none."""
    from corpusmill.operators import ngram

    rows = lines(docs.select("doc_id", "lang", "text"), "doc_id", "lang").where(F.regexp_like("line", F.lit(r"\p{L}")))
    own = rows.select("doc_id", F.col("line_no").alias("para_no"), "lang", without_quotes(F.col("line")).alias("text"), F.monotonically_increasing_id().alias("id"))
    own = storage.written(own)  # a line's number stays what it is
    found = ngram.classify_char(ngram.distances(own.select(F.col("id").alias("doc_id"), "text"), model)).select(F.col("doc_id").alias("id"), "predicted")
    return own.join(found, "id").where("predicted <> lang").select("doc_id", "para_no", F.col("predicted").alias("label"))


def font_ids(specs: DataFrame) -> DataFrame:
    """id, first: the first font id with the same size, family and colour."""
    same = specs.groupBy("size", "family", "color").agg(F.min("id").alias("first"))
    return specs.join(same, ["size", "family", "color"]).select("id", "first")


def merged_by_capital(rows: DataFrame, key: str) -> DataFrame:
    """key, para_no, text: a paragraph that begins with a small letter continues the one before."""
    w = Window.partitionBy(key).orderBy("line_no")
    starts = ~F.regexp_like("line", F.lit(r"^\p{Ll}"))
    joined = rows.withColumn("para_no", F.sum(starts.cast("int")).over(w)).groupBy(key, "para_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("text"))
    return joined.select(key, "para_no", "text")
