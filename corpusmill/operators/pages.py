"""Web pages and file names: paragraphs, links, URL rules, corpus paths, names."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.numbering import numbered

def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, href of every anchor."""
    return pages.select(key, F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


# Ends and parts of addresses that no crawl follows.
REJECTED_ENDS = (".pdf", ".jpg", ".png", ".gif", ".zip", ".mp3", ".mp4", ".doc", ".docx", ".xls", ".xlsx")
REJECTED_PARTS = ("mailto:", "javascript:", "/print/", "/search", "/login")


def fetchable(url: Column, host: str | None = None) -> Column:
    """Addresses of the host whose form a crawl accepts."""
    low = F.lower(url)
    ok = ~F.regexp_like(low, F.lit("(" + "|".join(e.replace(".", r"\.") for e in REJECTED_ENDS) + ")$")) & ~F.regexp_like(low, F.lit("|".join(REJECTED_PARTS)))
    return ok if host is None else ok & (url_host(url) == host)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def without_query(url: Column, kept: str = "page") -> Column:
    """The address without its query, but for one named part."""
    base, part = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, rf"[?&]({kept}=[^&#]*)", 1)
    return F.when(part != "", F.concat(base, F.lit("?"), part)).otherwise(base)


def corpus_path(path: Column) -> Column:
    """root, lang, dirsuffix, module, filepath of a path in a corpus; null outside of one. Module folders, and the suffix that a stage adds, are taken off."""
    rx = r"^(.*)/corpus-([^/]+)/(.*)$"
    folder = F.split(F.replace(F.regexp_extract(path, rx, 2), F.lit("-orig"), F.lit("")), "-")
    rest = F.regexp_extract(path, rx, 3)
    module = F.regexp_extract(rest, r"^(converted|analysed|korp_mono|tmx/[^/]+|korp_tmx/[^/]+|goldstandard/converted|prestable/converted|stable/converted)/", 1)
    tail = F.when(module != "", F.regexp_replace(F.substring(rest, F.length(module) + 2, F.length(rest)), r"\.[^./]+$", "")).otherwise(F.regexp_replace(rest, r"\.(xsl|log)$", ""))
    out = F.struct(F.regexp_extract(path, rx, 1).alias("root"), folder[0].alias("lang"), F.array_join(F.slice(folder, 2, 99), "-").alias("dirsuffix"), module.alias("module"), tail.alias("filepath"))
    return F.when(F.regexp_like(path, F.lit(rx)), out)


# Letters and signs that decomposition doesn't bring to ASCII. Cyrillic ones stand in small letters; capitals follow from them.
_LETTERS = {"đ": "d", "Đ": "D", "ŧ": "t", "Ŧ": "T", "ŋ": "ng", "Ŋ": "NG", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ʒ": "z", "Ʒ": "Z", "–": "-", "—": "--", "’": "'", "‘": "'", "“": '"', "”": '"', "„": '"', "…": "...", "«": "<<", "»": ">>", "ʼ": "'", "\u00a0": " "}
_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёӱӧӓӹӈ", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch \" y ' e iu ia io u o a y n".split(" "), strict=True))
_LETTERS |= _CYRILLIC | {k.upper(): v.capitalize() for k, v in _CYRILLIC.items()}


def ascii_name(name: str) -> str:
    """A file name in small ASCII letters: escapes decoded, letters transliterated, leading - and _ dropped, unwanted runs as _. A name with a path separator is an error."""
    if "/" in name:
        raise ValueError(f"not a file name: {name}")
    plain = "".join(_LETTERS.get(c, c) for c in unicodedata.normalize("NFC", unquote(name)))
    plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if ord(c) < 128)
    return re.sub(r"[+ ()'?,!<>\"&;#\\|$]+", "_", plain.lstrip("-_")).lower()


@F.pandas_udf(T.StringType())
def normalised_name(name: pd.Series) -> pd.Series:
    return name.map(ascii_name, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def unique_names(files: DataFrame, name: str, order: str) -> DataFrame:
    """Adds `unique`: the name, with _1, _2, … before its suffix from the second holder on. A name that very many files have is numbered in many tasks."""
    k = F.col("__k")
    stem, suffix = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    unique = F.when(k == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), k.cast("string"), suffix))
    return numbered(files, [name, order], [name], "__k", 0).withColumn("unique", unique).drop("__k", "__k_of")


def gold_sample(files: DataFrame, group: str, size: str, key: str) -> DataFrame:
    """Of each group's files by falling size, the fifth and every fourth after it."""
    placed = numbered(files.withColumn("__falling", -F.col(size)), [group, "__falling", key], [group], "__k")
    return placed.where("__k >= 5 and (__k - 5) % 4 = 0").drop("__k", "__k_of", "__falling")


def stage_counts(docs: DataFrame) -> DataFrame:
    """lang, original, converted, analysed and how many lack a stage. Inputs: lang and a flag for each stage."""
    c = F.count_if
    return docs.groupBy("lang").agg(F.count("*").alias("original"), c("converted").alias("converted"), c("analysed").alias("analysed"), c(~F.col("converted")).alias("lack_converted"), c(F.col("converted") & ~F.col("analysed")).alias("lack_analysed"))


def categories(files: DataFrame) -> DataFrame:
    """genre, files, in_open, in_closed over the files of open and closed corpora together."""
    return files.groupBy("genre").agg(F.count("*").alias("files"), F.bool_or(~F.col("closed")).alias("in_open"), F.bool_or("closed").alias("in_closed"))


# Content types and the suffixes of files saved from them, in the order of the tests.
SUFFIXES = {"text/html": ".html", "application/msword": ".doc", "application/pdf": ".pdf", "text/plain": ".txt"}


def saved_name(url: Column, content_type: Column, given: Column | None = None) -> Column:
    """File name for a fetched address: the name that the server gives, else the last folder of an address that ends in /, else index, with the content type's suffix unless the address ends in it."""
    stem = F.when(F.endswith(url, F.lit("/")), F.regexp_extract(url, r"([^/]*)/$", 1)).otherwise("index")
    suffix = F.lit("")
    for kind, s in reversed(SUFFIXES.items()):
        suffix = F.when(F.contains(content_type, F.lit(kind)) & ~F.endswith(url, F.lit(s)), s).otherwise(suffix)
    made = F.concat(stem, suffix)
    return made if given is None else F.coalesce(given, made)


def stem(name: Column, suffix: str = r"\.[^./]+") -> Column:
    """Last part of a path without its suffix."""
    return F.regexp_replace(F.regexp_replace(name, "^.*/", ""), suffix + "$", "")
