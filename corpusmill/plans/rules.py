"""Queries on smaller rules: languages of paragraphs, merged lines, model files, names, margins, semantic rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import dates
from corpusmill.functions import text as X
from corpusmill.operators import ngram
from corpusmill.operators import pages as G
from corpusmill.operators import paragraphs as P
from corpusmill.operators import relations as R
from corpusmill.plans.language_models import _MODELS
from corpusmill.sources import formats as S
from corpusmill.sources import tables
from corpusmill.sources.literals import dressed, dressed_sql
from corpusmill.sources.tables import load

_SEM = [(1, 1, 1, "guolli ◊", "guolli", "N", "N.Sem_Ani.Sem_Food.Sg", 2, "SUBJ→"), (1, 1, 2, "boahtá", "boahtit", "V", "V.Sg3", 0, "X"), (1, 1, 3, "gili", "gilli ◊", "N", "N.Sem_Plc.Gen", 2, "←OBJ"), (1, 1, 4, ".", ".", "CLB", "CLB", 2, "X")]
_SEM_SEEN = [
    (1, 1, 1, "guolli ◊", "guolli", "N", 3, "SUBJ"), (1, 1, 2, "guolli ◊", "Sem_Ani_Sem_Food", "N", 3, "SUBJ"), (1, 1, 3, "boahtá", "boahtit", "V", 0, "X"), (1, 1, 4, "gili", "gilli ◊", "N", 3, "OBJ"), (1, 1, 5, "gili", "Sem_Plc", "N", 3, "OBJ"),
    (1, 1, 6, ".", ".", "CLB", 3, "X"),
]
_FONTS = [(3, 12, "Times ◊", "#000"), (1, 12, "Times ◊", "#000"), (2, 14, "Times ◊", "#000"), (4, 14, "Times ◊", "#000")]
_FETCHED = [(1, "http://a.no/b/c◆/", "text/html; charset=utf-8"), (2, "http://a.no/b/c◆", "application/pdf"), (3, "http://a.no/x.pdf/", "application/pdf"), (4, "http://a.no/d◆/?q=1", "image/png"), (5, "http://a.no/e◆.pdf", "application/pdf")]
_SAVED = [(1, "c◆.html"), (2, "index.pdf"), (3, "x.pdf.pdf"), (4, "index"), (5, "index")]
_COLONS = [(1, "govva:Someone ◊", "govva: Someone ◊"), (2, "Govven: ok ◊", "Govven: ok ◊"), (3, "none:◊ x", "none:◊ x")]
_ANCHORS = [(1, "# c ◊ / d"), (2, "dog ◊ / beana"), (3, "cat ◊/"), (4, "a/b ◊/c"), (5, "& x / y ◊"), (6, "word / ◊ sátni ")]
_MODEL = [(1, "ab ◊\t12"), (2, ""), (3, "◊ c\t3")]
_TYPOS = [(1, "tset\ttest ◊"), (2, "tset\ttext ◊"), (3, "same ◊\tsame ◊"), (4, "none ◊"), (5, "x ◊\ty ◊")]


def paragraph_languages(spark, d):
    docs = load(spark, d, "documents")
    return P.labelled(docs, ngram.char_model(docs)).groupBy("label").agg(F.count("*").alias("paragraphs"), F.count_distinct("doc_id").alias("documents"))


def merged_lines(spark, d):
    return P.merged_by_capital(P.lines(load(spark, d, "documents"), "doc_id"), "doc_id").select("doc_id", "para_no", F.md5("text").alias("digest"))


def font_ids(spark, d):
    return P.font_ids(dressed(spark, d, "id int, size int, family string, color string", _FONTS))


def model_files(spark, d):
    return S.model_lines(ngram.char_model(load(spark, d, "documents")))


def model_reader(spark, d):
    return tables.model_rows(dressed(spark, d, "id int, value string", _MODEL))


def anchor_reader(spark, d):
    return S.anchor_lines(tables.anchor_pairs(dressed(spark, d, "id int, value string", _ANCHORS), 2, 0, 1))


def typo_reader(spark, d):
    return tables.typo_pairs(dressed(spark, d, "at int, value string", _TYPOS), "at")


def semantic_rows(spark, d):
    t = dressed(spark, d, "text_id int, sentence_id int, position int, word string, lemma string, pos string, msd string, dephead int, deprel string", _SEM)
    return R.semantic_rows(t).withColumn("deprel", R.folded_labels(F.col("deprel")))


def categories(spark, d):
    return G.categories(load(spark, d, "documents").select(F.col("source").alias("genre"), (F.length("text") % 2 == 0).alias("closed")))


def saved_names(spark, d):
    return dressed(spark, d, "id int, url string, kind string", _FETCHED).select("id", G.saved_name(F.col("url"), F.col("kind")).alias("name"))


def page_stems(spark, d):
    return load(spark, d, "pages").select("page_id", G.stem(F.regexp_replace("url", r"\?.*$", "")).alias("stem"))


def page_margins(spark, d):
    own = F.create_map(F.lit("3"), F.lit(9), F.lit("even"), F.lit(4))
    return load(spark, d, "pages").groupBy(dates.margin_of(F.col("page_id"), own, 7).alias("margin")).agg(F.count("*").alias("pages"))


def colon_spaces(spark, d):
    return dressed(spark, d, "id int, text string", [(k, t) for k, t, _ in _COLONS]).select("id", X.colon_space(F.col("text"), ["govva", "govven", "govvejeaddji"]).alias("text"))


def package_ids(spark, d):
    return S.package_ids(load(spark, d, "pages").select("page_id"), "page_id")


def corpus_facts(spark, d):
    docs = load(spark, d, "documents")
    date = F.when(F.col("doc_id") % 4 == 0, "00000000").otherwise(F.concat((F.lit(1990) + F.col("doc_id") % 30).cast("string"), F.lit("0101")))
    counts = R.text_counts(R.derived_tokens(docs))
    return S.corpus_facts(docs.select(F.col("doc_id").alias("text_id"), F.col("source").alias("genre"), date.alias("datefrom")).join(counts, "text_id")).withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


QUERIES = {
    f.__name__: f
    for f in (paragraph_languages, merged_lines, font_ids, model_files, model_reader, anchor_reader, typo_reader, semantic_rows, categories, saved_names, page_stems, page_margins, colon_spaces, package_ids, corpus_facts)
}
from corpusmill.plans.corpus import _TOK  # noqa: E402

_LINES = "(select doc_id, generate_subscripts(l, 1) as line_no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents))"
ORACLE = {
    "saved_names": f"select * from {dressed_sql('id, name', _SAVED, _FETCHED)}",
    "colon_spaces": f"select * from {dressed_sql('id, text', [(k, e) for k, _, e in _COLONS])}",
    "semantic_rows": f"select * from {dressed_sql('text_id, sentence_id, position, word, lemma, pos, dephead, deprel', _SEM_SEEN, _SEM)}",
    "merged_lines": f"select doc_id, para_no, md5(string_agg(line, ' ' order by line_no)) as digest from (select *, sum((not regexp_matches(line, '^\\p{{Ll}}'))::int) over (partition by doc_id order by line_no)::bigint as para_no from {_LINES}) group by doc_id, para_no",
    "font_ids": f"select id, min(id) over (partition by size, family, color) as first from {dressed_sql('id, size, family, color', _FONTS)}",
    "model_files": _MODELS + " z as (select 1) select lang, rank, gram || chr(9) || freq as value from lg_r",
    "model_reader": f"select string_split(value, chr(9))[1] as gram, string_split(value, chr(9))[2]::bigint as freq from {dressed_sql('id, value', _MODEL)} where trim(value) <> ''",
    "anchor_reader": f"select trim(p[1]) || ' / ' || trim(p[2]) as value from (select value, string_split(value, '/') as p from {dressed_sql('id, value', _ANCHORS)}) where value[1] not in ('#', '&') and len(p) = 2 and trim(p[1]) <> '' and trim(p[2]) <> ''",
    "typo_reader": f"select p[1] as typo, arg_max(p[2], n) as correction from (select n, string_split(value, chr(9)) as p from {dressed_sql('n, value', _TYPOS)}) where len(p) = 2 and p[1] <> p[2] group by 1",
    "categories": "select source as genre, count(*) as files, bool_or(length(text) % 2 = 1) as in_open, bool_or(length(text) % 2 = 0) as in_closed from documents group by source",
    "page_stems": r"select page_id, regexp_replace(regexp_replace(regexp_replace(url, '\?.*$', ''), '^.*/', ''), '\.[^./]+$', '') as stem from pages",
    "page_margins": "select case when page_id = 3 then 9 when page_id % 2 = 0 then 4 else 7 end as margin, count(*) as pages from pages group by 1",
    "package_ids": "select page_id, lpad((row_number() over (order by page_id))::varchar, 6, '0') as package_id from pages",
    "corpus_facts": _TOK + "select source as genre, count(distinct text_id * 1000000 + sentence_id)::bigint as sentences, min(case when text_id % 4 <> 0 then make_date(1990 + text_id % 30, 1, 1) end)::varchar as first, max(case when text_id % 4 <> 0 then make_date(1990 + text_id % 30, 1, 1) end)::varchar as last from tok group by source",
}
