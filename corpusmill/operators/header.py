"""A document's header from its metadata file and what the document itself says: one projection, by rules of precedence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of a person's name in metadata and in a header; versions that a header names, and what it calls them.
PERSON = {"fn": "firstname", "ln": "lastname", "gender": "sex", "born": "born", "nat": "nationality"}
VERSIONS = {
    "template_version": "XSLtemplate ", "current_version": "file-specific xsl  ", "common_version": "common.xsl  ", "convert2xml_version": "convert2xml  ",
    "hyph_version": "add_hyph_tags  ", "docbook2corpus2_version": "docbook2corpus2  ", "xhtml2corpus_version": "xhtml2corpus  ",
}
#: Fields that the metadata file gives, or else the document, or else are as here (null: left out).
EITHER = {"title": "", "genre": "", "translated_from": None, "year": None, "place": None, "collection": None, "wordcount": None}


def _reader(column: str) -> Callable[[str], Column]:
    """A value of a map, null if it is empty."""
    return lambda name: F.nullif(F.try_element_at(F.col(column), F.lit(name)), F.lit(""))


def merged(docs: DataFrame, key: str, meta: str = "meta", own: str = "own") -> DataFrame:
    """key and the header's fields. Inputs: maps of what the metadata file says and of what the document says (an empty value says nothing).

    Persons are structs; only the first author and the translator can be unknown, and are then a struct of nulls with `unknown`.
    """
    m, o = _reader(meta), _reader(own)

    def person(who: str) -> Column:
        parts = [F.coalesce(m(f"{who}_{short}"), F.lit("")).alias(name) for short, name in PERSON.items()]
        return F.when(m(f"{who}_ln").isNotNull(), F.struct(*parts, F.lit(None).cast("string").alias("said"), F.lit(False).alias("unknown")))

    def said(text: Column, unknown: bool) -> Column:
        return F.struct(*(F.lit(None).cast("string").alias(name) for name in PERSON.values()), text.alias("said"), F.lit(unknown).alias("unknown"))

    nobody = said(F.lit(None).cast("string"), True)
    abroad = m("translated_from").isNotNull() | o("translated_from").isNotNull()
    published = F.concat_ws(" ", m("publisher"), *(F.concat(F.lit(f"{n} "), F.coalesce(m(n), o(n))) for n in ("ISSN", "ISBN")))
    licence = F.when(F.contains(m("license_type"), F.lit("free")), "free").otherwise(F.concat(F.lit("license "), m("license_type")))
    versions = [F.concat(F.lit(label), m(name), F.lit("; ")) for name, label in VERSIONS.items()]
    fields = {
        "lang": F.coalesce(m("mainlang"), o("lang"), F.lit("")),
        **{f: F.coalesce(m(f), o(f), *([F.lit(end)] if end is not None else [])) for f, end in EITHER.items()},
        "author1": F.coalesce(person("author1"), F.when(o("author").isNotNull(), said(o("author"), False)), nobody),
        **{f"author{k}": person(f"author{k}") for k in (2, 3, 4)},
        "translator": F.coalesce(person("translator"), F.when(o("translator").isNull() & abroad, nobody)),
        "publication": F.when(m("publisher").isNotNull(), published).when(F.contains(m("publChannel"), F.lit("unpublished")), "unpublished").otherwise(o("publChannel")),
        "conversion_status": F.coalesce(m("conversion_status"), F.lit("standard")),
        "availability": F.when(m("license_type").isNotNull(), licence).when(o("availability").isNull(), "license standard"),
        "submitter": F.when(m("sub_email").isNotNull(), F.concat_ws(" ", F.coalesce(m("sub_name"), F.lit("")), m("sub_email"))).when(m("sub_name").isNotNull(), ""),
        "multilingual": F.when(m("monolingual").isNull(), F.coalesce(m("mlangs"), F.lit(""))),
        "file": m("filename"),
        "metadata": F.when(m("metadata").isNotNull(), F.when(F.contains(m("metadata"), F.lit("uncomplete")), "uncomplete").otherwise("complete")).otherwise(o("metadata")),
        "version": reduce(F.concat, (F.coalesce(v, F.lit("")) for v in versions)),
        "note": m("note"), "orthography": m("orthography"),
    }
    return docs.select(key, *(c.alias(name) for name, c in fields.items()))
