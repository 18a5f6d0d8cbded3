"""Queries on annotated text, projections, pages, paths, names and incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import annotations as N
from corpusmill.operators import header as H
from corpusmill.operators import pages as G
from corpusmill.sources.literals import dressed, dressed_sql, values
from corpusmill.sources.tables import load
from corpusmill.streaming import ingest

_MARKUP = [
    (1, "no error here ◊"), (2, "one {wrong ◊}${right} word"), (3, "{a}¢{noun|b ◊///c} and {d}€{e} ◊ end"), (4, "x {y {z}${zz ◊} w}£{whole} t"), (5, "bad ◊ {a}#{b}"), (6, "open ◊ {a"), (7, "{two ◊ words}‰{two ◊  words}"),
]
_MARKUP_SEEN = [
    (2, "1", 1, "errorort", "wrong ◊", "", "right", " word", None), (3, "1", 1, "errorortreal", "a", "noun", "b ◊|c", " and ", None), (3, "2", 1, "errorlex", "d", "", "e", " ◊ end", None), (4, "1", 1, "errormorphsyn", "y z w", "", "whole", " t", None),
    (4, "1.1", 2, "errorort", "z", "", "zz ◊", " w", None), (5, None, 0, None, None, None, None, None, "unknown error symbol «#»"), (6, None, 0, None, None, None, None, None, "an error is open at the end of the line"),
    (7, "1", 1, "errorformat", "two ◊ words", "", "two ◊  words", "", None),
]
_MARKUP_TEXTS = [(1, "no error here ◊", "no error here ◊"), (2, "one wrong ◊ word", "one right word"), (3, "a and d ◊ end", "b ◊ and e ◊ end"), (4, "x y z w t", "x whole t"), (5, None, None), (6, None, None), (7, "two ◊ words", "two ◊  words")]
_PATHS = [(1, "/c/corpus-sme/converted/admin/◊/a/b.html.xml"), (2, "/c/corpus-sme-orig-x-closed/admin/◊/f.pdf.xsl"), (3, "/c/corpus-nob-orig/ficti/◊ g.txt"), (4, "/c/corpus-sme/tmx/nob/admin/◊/h.html.tmx"), (5, "/tmp/◊/x.txt"), (6, "/c/corpus-smj-x-y/korp_mono/◊/k.txt.xml")]
_NAMES = [(1, "Ođđa Fiila◆ (1).txt"), (2, "__x+◆y.txt"), (3, "%C3%A1rran◆.PDF"), (4, "a b◆.txt"), (5, "a_b◆.txt"), (6, "A b◆.txt"), (7, "-_-z◆?.doc"), (8, "Кириллица◆.txt"), (9, "a–b “c◆”.txt"), (10, "Ŋuova Щи◆.txt")]
_NAMES_SEEN = [(1, "odda_fiila◆_1_.txt"), (2, "x_◆y.txt"), (3, "arran◆.pdf"), (4, "a_b◆.txt"), (5, "a_b◆.txt"), (6, "a_b◆.txt"), (7, "z◆_.doc"), (8, "kirillitsa◆.txt"), (9, "a-b_c◆_.txt"), (10, "nguova_shchi◆.txt")]


def error_markup_parse(spark, d):
    return N.markup_errors(dressed(spark, d, "id int, line string", _MARKUP), "id", "line").select("id", "path", F.coalesce("depth", F.lit(0)).alias("depth"), "kind", "error_text", "info", F.array_join("suggestions", "|").alias("suggestions"), "tail", "problem")


def error_markup_texts(spark, d):
    return dressed(spark, d, "id int, line string", _MARKUP).select("id", N.markup_texts(F.col("line")).alias("t")).select("id", "t.*")


def error_counts(spark, d):
    e = N.markup_errors(dressed(spark, d, "id int, line string", _MARKUP), "id", "line")
    return e.where("problem is null").groupBy("kind").agg(F.count("*").alias("n"))


#: Readings of analysed words, in turn ($ the word, % the place of its head), and what a token table shows: lemma, pos, msd in Northern Sámi and elsewhere, function.
_READINGS = [
    ("$\" N Sem/Hum Sg Nom @SUBJ> #&->%", "$", "N", "N.Sem_Hum.Sg.Nom", "N.Sg.Nom", "SUBJ>"),
    ("$\" N Sem/Build_Org Sg Loc @<ADVL #&->%", "$", "N", "N.Sem_Plc.Sem_Org.Sg.Loc", "N.Sg.Loc", "<ADVL"),
    ("$\" N Sem/Hum-prof Pl Acc <W:1.25> @<OBJ #&->%", "$", "N", "N.Sem_Hum.Pl.Acc", "N.Pl.Acc", "<OBJ"),
    ("a$\" V TV Err/Orth Inf @IMV #&->%\n\t\"ÿÿ$\" A Attr @>N #&->%\n\t\"$\" A Attr @>N #&->%", "$", "A", "A.Attr", "A.Attr", ">N"),
    ("$\" <mv> V TV Ind Prs Sg3 @FMV #&->%", "$", "V", "V.Ind.Prs.Sg3", "V.Ind.Prs.Sg3", "FMV"),
    ("$\" <aux> V IV Ind Prt Pl1 @FAUX #&->%", "$", "V", "V.Ind.Prt.Pl1", "V.Ind.Prt.Pl1", "NAUX"),
    ("$\" ? @X #&->%", "$", "___", "___", "___", "X"),
    ("$\" Ex/V TV Der/NomAg N Sg Nom @<SPRED #&->%", "$", "N", "N.Sg.Nom", "N.Sg.Nom", "<SPRED"),
    ("$\" N Sem/Veh Sg Gen @>N #&->%\n\t\t\"first\" N Cmp/SgNom Cmp", "$", "N", "N.Sem_Veh.Sg.Gen", "N.Sg.Gen", ">N"),
    ("$\" Adv Use/NG Gram/TAbbr OLang/SME Sem/Time @ADVL #&->%", "$", "Adv", "Adv.Sem_Time", "Adv", "ADVL"),
    ("$\" N Sem/Group_Hum <cs> Pl Nom @SUBJ #&->%", "$", "N", "N.Sem_Hum.Pl.Nom", "N.Pl.Nom", "SUBJ"),
    ("$\" CC #&->%", "$", "CC", "CC", "CC", "X"),
    ("$\" Pron Relc Sg Nom Err/Lex @SUBJ> #&->%", "$", "Pron", "Pron.Rel.Sg.Nom", "Pron.Rel.Sg.Nom", "SUBJ>"),
    ("$\" Ex/N Sem/Obj Der/Dimin N Sem/Obj Sg Ill @ADVL> #&->%\n\t\t\"kant\" N Cmp/SgNom Cmp", "$", "N", "N.Sem_Obj.Sg.Ill", "N.Sg.Ill", "ADVL>"),
]


def _words(spark, d):
    """doc_id, lang, sentence, ws: lines of documents as words of small letters."""
    lines = load(spark, d, "documents").select("doc_id", F.when(F.col("lang").isin("en", "de"), "sme").otherwise("smj").alias("lang"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "l"))
    return lines.select("doc_id", "lang", "k", F.filter(F.split(F.regexp_replace(F.lower("l"), "[^a-zà-öø-ÿ]+", " "), " "), lambda w: w != "").alias("ws")).where("size(ws) > 0")


def _analysed(spark, d):
    """doc_id, lang, dependency: an analysis of every word by a fixed rule."""

    def cohort(w, i):
        reading = F.element_at(F.array(*(F.lit(r[0]) for r in _READINGS)), (i % len(_READINGS) + 1).cast("int"))
        reading = F.replace(F.replace(F.replace(reading, F.lit("$"), w), F.lit("&"), (i + 1).cast("string")), F.lit("%"), i.cast("string"))
        return F.concat(F.lit('"<'), w, F.lit('>"\n\t"'), reading, F.when(i % 3 == 1, "\n: ").otherwise(""))

    stop = F.format_string('\n"<.>"\n\t"." CLB #%d->0\n', F.size("ws") + 1)
    sents = _words(spark, d).select("doc_id", "lang", "k", F.concat(F.array_join(F.transform("ws", cohort), "\n"), stop).alias("s"))
    joined = sents.groupBy("doc_id", "lang").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("ss"))
    text = F.concat(F.lit(": \n"), F.array_join(F.transform("ss", lambda x: x["s"]), "\n"), F.lit('\n"<¶>"\n\t"¶" CLB\n'))
    return joined.select("doc_id", "lang", text.alias("dependency"))


def parse_analysis(spark, d):
    return N.parse_analysis(_analysed(spark, d), "doc_id")


def known_sentences(spark, d):
    return N.known_sentences(_analysed(spark, d), "doc_id")


def _paras(spark, d):
    """Lines of documents as paragraphs by a fixed rule: type from the line's number modulo 4, French every fifth, a marked error every seventh word."""
    docs = load(spark, d, "documents")
    lines = docs.select("doc_id", F.col("lang").alias("doc_lang"), F.posexplode(F.split("text", "\n")).alias("para_no", "line"))
    kind = F.element_at(F.array(F.lit(None).cast("string"), F.lit("title"), F.lit("listitem"), F.lit("tablecell")), (F.col("para_no") % 4 + 1).cast("int"))
    run = lambda w, i: F.struct(F.when(i % 7 == 6, "errorort").otherwise("text").alias("kind"), F.concat(w, F.lit(" ")).alias("text"), F.concat(F.lit("*"), w, F.lit(" ")).alias("correct"))
    return lines.select("doc_id", "doc_lang", "para_no", kind.alias("type"), F.when(F.col("para_no") % 5 == 0, "fr").alias("lang"), F.transform(F.split("line", " "), run).alias("runs"))


def _digested(df):
    return df.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def ccat_project(spark, d):
    return _digested(N.project(_paras(spark, d), "doc_id", N.Projection()))


def ccat_titles(spark, d):
    return _digested(N.project(_paras(spark, d), "doc_id", N.Projection(title=True, table=True)))


def ccat_lang_invert(spark, d):
    return _digested(N.project(_paras(spark, d), "doc_id", N.Projection(every=True, lang="fr", invert_lang=True)))


def ccat_corrections(spark, d):
    return _digested(N.project(_paras(spark, d), "doc_id", N.Projection(corrected=("errorort",))))


def ccat_words(spark, d):
    return _digested(N.project(_paras(spark, d), "doc_id", N.Projection(one_word_per_line=True)))


def orthography_filter(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 1, "old").when(F.col("doc_id") % 3 == 2, "").alias("orthography"))
    return N.orthography(docs, None).select("doc_id", F.lit("none").alias("wanted")).union(N.orthography(docs, "old").select("doc_id", F.lit("old")))


def page_links(spark, d):
    return G.links(load(spark, d, "pages")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


def url_filter(spark, d):
    u = F.col("url")
    return load(spark, d, "pages").where(G.fetchable(u)).select("page_id", G.url_host(u).alias("host"), G.without_query(u).alias("address"))


def frontier(spark, d):
    pages = load(spark, d, "pages").select(G.without_query(F.col("url")).alias("address"), "page_id")
    seen = pages.where("page_id % 2 = 0").select("address").distinct()
    return pages.select("address").distinct().join(seen, "address", "left_anti")


def page_digest_dupes(spark, d):
    return load(spark, d, "pages").groupBy(F.md5("html").alias("digest")).agg(F.max_by("url", "page_id").alias("url"), F.count("*").alias("n"))


def path_parse(spark, d):
    return dressed(spark, d, "id int, path string", _PATHS).select("id", G.corpus_path(F.col("path")).alias("p")).select("id", "p.*")


def filename_normalise(spark, d):
    return dressed(spark, d, "id int, name string", _NAMES).select("id", G.normalised_name("name").alias("name"))


def unique_names(spark, d):
    return G.unique_names(load(spark, d, "pages").select("page_id", F.regexp_extract("url", "([^/?]*)(\\?.*)?$", 1).alias("name")), "name", "page_id").select("page_id", "unique")


def stage_completeness(spark, d):
    return G.stage_counts(load(spark, d, "documents").select("lang", (F.col("doc_id") % 4 != 0).alias("converted"), (F.col("doc_id") % 4 > 1).alias("analysed")))


def gold_sample(spark, d):
    return G.gold_sample(load(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("size")), "lang", "size", "doc_id")


#: Fields of metadata files and of documents, and which documents have them: those whose id the number divides.
_META = {
    "mainlang": 3, "title": 2, "genre": 5, "author1_ln": 4, "author1_fn": 8, "author1_born": 3, "author2_ln": 6, "author3_ln": 9, "author3_gender": 2, "author4_ln": 10, "translator_ln": 7, "translator_nat": 2, "translated_from": 5,
    "year": 3, "place": 4, "publisher": 4, "ISSN": 8, "ISBN": 6, "publChannel": 5, "collection": 6, "wordcount": 7, "conversion_status": 11, "license_type": 3, "sub_name": 2, "sub_email": 3, "monolingual": 4, "mlangs": 3, "filename": 2,
    "metadata": 5, "template_version": 2, "common_version": 3, "xhtml2corpus_version": 5, "note": 9, "orthography": 10,
}
_OWN = {"lang": 2, "title": 3, "genre": 2, "author": 5, "translator": 6, "translated_from": 4, "year": 2, "place": 3, "publChannel": 2, "collection": 5, "wordcount": 2, "availability": 4, "metadata": 3, "ISSN": 3}


def _says(fields, mark):
    """A map of fields; every second value that is there is empty where the id ends in 1, and some values hold what the rules look for."""
    k = F.col("doc_id")
    special = F.when(k % 10 == 0, "unpublished free uncomplete ").otherwise("")
    value = lambda f, n: F.when(k % n == 0, F.when(k % 10 == 2, "").otherwise(F.concat(special, F.lit(f"{mark}{f} "), "source")))
    return F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(f).alias("key"), value(f, n).alias("value")) for f, n in fields.items())), lambda e: e["value"].isNotNull()))


def header_merge(spark, d):
    docs = load(spark, d, "documents").select("doc_id", _says(_META, "").alias("meta"), _says(_OWN, "own ").alias("own"))
    found = H.merged(docs, "doc_id")
    persons = [c for c, kind in found.dtypes if kind.startswith("struct")]
    shown = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("|", *(f"{c}.{n}" for n in H.PERSON.values()), f"{c}.said", F.when(F.col(f"{c}.unknown"), "unknown")))
    return found.withColumns({c: shown(c) for c in persons})


def nfc_digest(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(G.nfc("text")).alias("digest"))


def incremental_ingest(spark, d):
    at = ingest.workspace(spark)
    schema = load(spark, d, "events").schema
    return ingest.ingest(spark, f"{d}/events*.parquet", f"{at}/table", f"{at}/log", schema, ("event_id", "ts", "user_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def window_counts(spark, d):
    at = ingest.workspace(spark)
    schema = load(spark, d, "events").schema
    out = ingest.window_counts(spark, f"{d}/events*.parquet", schema, "1 hour", f"{at}/table", f"{at}/log")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (error_markup_parse, error_markup_texts, error_counts, parse_analysis, known_sentences, ccat_project, ccat_titles, ccat_lang_invert, ccat_corrections, ccat_words, orthography_filter, page_links, url_filter, frontier, page_digest_dupes, path_parse, filename_normalise, unique_names, stage_completeness, gold_sample, header_merge, nfc_digest, incremental_ingest, window_counts)
}


def _project(where: str, correct: bool = False, words: bool = False) -> str:
    word = "case when (i - 1) % 7 = 6 then '*' || w else w end" if correct else "w"
    end = "regexp_replace(t, '[ \\t]+', chr(10), 'g') || chr(10)" if words else "t || ' ¶' || chr(10)"
    return f"""with l as (select doc_id, lang as doc_lang, generate_subscripts(x, 1) - 1 as para_no, unnest(x) as line from (select doc_id, lang, string_split(text, chr(10)) as x from documents)),
p as (select *, [null, 'title', 'listitem', 'tablecell'][para_no % 4 + 1] as type, case when para_no % 5 = 0 then 'fr' end as lang from l),
w as (select doc_id, para_no, type, lang, doc_lang, generate_subscripts(s, 1) as i, unnest(s) as w from (select *, string_split(line, ' ') as s from p where {where})),
t as (select doc_id, para_no, rtrim(string_agg({word} || ' ', '' order by i), ' ') as t from w group by all)
select doc_id, length(text) as chars, md5(text) as digest from (select doc_id, string_agg({end}, '' order by para_no) as text from t where t <> '' group by doc_id)"""


_ADDRESS = r"case when regexp_extract(url, '[?&](page=[^&#]*)', 1) <> '' then regexp_extract(url, '^([^?#]*)', 1) || '?' || regexp_extract(url, '[?&](page=[^&#]*)', 1) else regexp_extract(url, '^([^?#]*)', 1) end"
_ENDS = "(" + "|".join(e.replace(".", r"\.") for e in G.REJECTED_ENDS) + ")$"
_STREAM = "select event_type, count(*) as n, min(event_id) as first, max(event_id) as last from events group by event_type"
_RX = "^(.*)/corpus-([^/]+)/(.*)$"
_MOD = "^(converted|analysed|korp_mono|tmx/[^/]+|korp_tmx/[^/]+|goldstandard/converted|prestable/converted|stable/converted)/"
_WORDS_SQL = """with ls as (select doc_id, case when lang in ('en', 'de') then 'sme' else 'smj' end as lang, generate_subscripts(x, 1) as k, unnest(x) as l from (select doc_id, lang, string_split(coalesce(text, ''), chr(10)) as x from documents)),
ws as (select doc_id, lang, k, list_filter(string_split(regexp_replace(lower(l), '[^a-zà-öø-ÿ]+', ' ', 'g'), ' '), lambda w: w <> '') as ws from ls),
num as (select *, row_number() over (partition by doc_id order by k) as sentence_no from ws where len(ws) > 0),
tok as (select doc_id, lang, sentence_no, generate_subscripts(ws, 1) as position, unnest(ws) as word from num)"""

def _field(f, n, mark):
    """SQL of a field, null where it says nothing."""
    return f"case when doc_id % {n} = 0 and doc_id % 10 <> 2 then case when doc_id % 10 = 0 then 'unpublished free uncomplete ' else '' end || '{mark}{f} ' || source end"


_M, _O = {f: _field(f, n, "") for f, n in _META.items()}, {f: _field(f, n, "own ") for f, n in _OWN.items()}


def _person_sql(who):
    parts = " || '|' || ".join(f"coalesce({_M[f'{who}_{p}']}, '')" if f"{who}_{p}" in _M else "''" for p in ("fn", "ln", "gender", "born", "nat"))
    return f"case when ({_M[f'{who}_ln']}) is not null then {parts} end"


_HEADER_SQL = "select doc_id, " + ", ".join(f"{sql} as {name}" for name, sql in {
    "lang": f"coalesce({_M['mainlang']}, {_O['lang']}, '')",
    **{f: f"coalesce({_M[f]}, {_O[f]}, '')" for f in ("title", "genre")}, **{f: f"coalesce({_M[f]}, {_O[f]})" for f in ("year", "place", "collection", "wordcount")}, "translated_from": f"coalesce({_M['translated_from']}, {_O['translated_from']})",
    "author1": f"coalesce({_person_sql('author1')}, {_O['author']}, 'unknown')", **{f"author{k}": _person_sql(f"author{k}") for k in (2, 3, 4)},
    "translator": f"coalesce({_person_sql('translator')}, case when ({_O['translator']}) is null and coalesce({_M['translated_from']}, {_O['translated_from']}) is not null then 'unknown' end)",
    "publication": f"case when ({_M['publisher']}) is not null then ({_M['publisher']}) || coalesce(' ISSN ' || coalesce({_M['ISSN']}, {_O['ISSN']}), '') || coalesce(' ISBN ' || ({_M['ISBN']}), '') when ({_M['publChannel']}) like '%unpublished%' then 'unpublished' else {_O['publChannel']} end",
    "conversion_status": f"coalesce({_M['conversion_status']}, 'standard')",
    "availability": f"case when ({_M['license_type']}) like '%free%' then 'free' when ({_M['license_type']}) is not null then 'license ' || ({_M['license_type']}) when ({_O['availability']}) is null then 'license standard' end",
    "submitter": f"case when ({_M['sub_email']}) is not null then coalesce({_M['sub_name']}, '') || ' ' || ({_M['sub_email']}) when ({_M['sub_name']}) is not null then '' end",
    "multilingual": f"case when ({_M['monolingual']}) is null then coalesce({_M['mlangs']}, '') end", "file": _M["filename"],
    "metadata": f"case when ({_M['metadata']}) like '%uncomplete%' then 'uncomplete' when ({_M['metadata']}) is not null then 'complete' else {_O['metadata']} end",
    "version": f"coalesce('XSLtemplate ' || ({_M['template_version']}) || '; ', '') || coalesce('common.xsl  ' || ({_M['common_version']}) || '; ', '') || coalesce('xhtml2corpus  ' || ({_M['xhtml2corpus_version']}) || '; ', '')",
    "note": _M["note"], "orthography": _M["orthography"],
}.items()) + " from documents"

ORACLE = {
    "error_markup_parse": f"select * from {dressed_sql('id, path, depth, kind, error_text, info, suggestions, tail, problem', _MARKUP_SEEN, _MARKUP)}",
    "error_markup_texts": f"select * from {dressed_sql('id, uncorrected, corrected', _MARKUP_TEXTS, _MARKUP)}",
    "error_counts": f"select kind, count(*) as n from {dressed_sql('id, path, depth, kind, error_text, info, suggestions, tail, problem', _MARKUP_SEEN, _MARKUP)} where problem is null group by kind",
    "parse_analysis": _WORDS_SQL
    + f""", seen as (select * from {values('m, lemma, pos, msd, msd_other, deprel', [(k, *r[1:]) for k, r in enumerate(_READINGS)])})
select doc_id, cast(sentence_no as int) as sentence_no, cast(position as int) as position, word, replace(lemma, '$', word) as lemma, pos, case when lang = 'sme' then msd else msd_other end as msd,
  position::varchar as ref, deprel, (position - 1)::varchar as dephead from tok join seen on (position - 1) % {len(_READINGS)} = m
union all select doc_id, cast(sentence_no as int), cast(max(position) + 1 as int), '.', '.', 'CLB', 'CLB', (max(position) + 1)::varchar, 'X', '0' from tok group by doc_id, sentence_no""",
    "filename_normalise": f"select * from {dressed_sql('id, name', _NAMES_SEEN, _NAMES)}",
    "known_sentences": _WORDS_SQL
    + f""", good as (select * from num where len(ws) <= {[r[0].startswith('$" ?') for r in _READINGS].index(True)})
select doc_id, cast(row_number() over (partition by doc_id order by k) as bigint) as sentence_no, array_to_string([w || case when i % 3 = 2 then ' ' else '' end for w, i in ws], '') || '.' as sentence from good""",
    "ccat_project": _project("coalesce(type, 'text') = 'text'"),
    "ccat_titles": _project("type in ('title', 'tablecell')"),
    "ccat_lang_invert": _project("coalesce(lang, doc_lang) <> 'fr'"),
    "ccat_corrections": _project("coalesce(type, 'text') = 'text'", correct=True),
    "ccat_words": _project("coalesce(type, 'text') = 'text'", words=True),
    "orthography_filter": "select doc_id, 'none' as wanted from documents where doc_id % 3 <> 1 union all select doc_id, 'old' from documents where doc_id % 3 = 1",
    "page_links": "select page_id, href, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) as href from pages) group by all",
    "url_filter": f"select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, {_ADDRESS} as address from pages where not regexp_matches(lower(url), '{_ENDS}') and not regexp_matches(lower(url), '{'|'.join(G.REJECTED_PARTS)}')",
    "frontier": f"select distinct {_ADDRESS} as address from pages except select {_ADDRESS} from pages where page_id % 2 = 0",
    "page_digest_dupes": "select md5(html) as digest, arg_max(url, page_id) as url, count(*) as n from pages group by 1",
    "path_parse": f"""select id, case when ok then regexp_extract(path, '{_RX}', 1) end as root, case when ok then f[1] end as lang, case when ok then array_to_string(f[2:], '-') end as dirsuffix,
  case when ok then m end as module, case when not ok then null when m <> '' then regexp_replace(r[length(m) + 2:], '\\.[^./]+$', '') else regexp_replace(r, '\\.(xsl|log)$', '') end as filepath
  from (select *, regexp_extract(r, '{_MOD}', 1) as m from (select id, path, regexp_matches(path, '{_RX}') as ok, string_split(replace(regexp_extract(path, '{_RX}', 2), '-orig', ''), '-') as f, regexp_extract(path, '{_RX}', 3) as r from {dressed_sql("id, path", _PATHS)}))""",
    "unique_names": "select page_id, case when k = 0 then name else regexp_replace(name, '\\.[^.]*$', '') || '_' || k || regexp_extract(name, '(\\.[^.]*)$', 1) end as unique from (select page_id, name, row_number() over (partition by name order by page_id) - 1 as k from (select page_id, regexp_extract(url, '([^/?]*)(\\?.*)?$', 1) as name from pages))",
    "stage_completeness": "select lang, count(*) as original, count(*) filter (doc_id % 4 <> 0) as converted, count(*) filter (doc_id % 4 > 1) as analysed, count(*) filter (doc_id % 4 = 0) as lack_converted, count(*) filter (doc_id % 4 = 1) as lack_analysed from documents group by lang",
    "gold_sample": "select doc_id, lang, size from (select doc_id, lang, length(text) as size, row_number() over (partition by lang order by length(text) desc, doc_id) as n from documents) where n >= 5 and (n - 5) % 4 = 0",
    "header_merge": _HEADER_SQL,
    "nfc_digest": "select doc_id, md5(nfc_normalize(text)) as digest from documents",
    "incremental_ingest": _STREAM,
    "window_counts": "select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all",
}
