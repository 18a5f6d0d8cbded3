"""Queries on analysis strings, marked-up paragraphs and the index of relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import annotations as N
from corpusmill.operators import paragraphs as P
from corpusmill.operators import readings as G
from corpusmill.operators import relations as R
from corpusmill.plans.corpus import _CASES, _TOK
from corpusmill.sources.literals import dressed, dressed_sql, values
from corpusmill.sources.tables import load

_LINES = [
    (1, '\t"girji ◊" N Sg Nom @SUBJ> #1->2', "girji ◊_∞_N Sg Nom @SUBJ> #1->2"), (2, '\t"dievva" N Sg Nom\n\t\t"girji ◊" N Cmp\n', 'dievva_∞_N Sg Nom_™__™_girji ◊_∞_N Cmp'),
    (3, '"a ◊" V\n\t"b" N', 'a ◊_∞_V_™_"b_∞_N'),
]
_SEM = [
    (1, "x ◊_∞_N Sem/Hum-prof Sg Nom", "x ◊_∞_N Sem/Hum Sg Nom"), (2, "x ◊_∞_N Sem/Build Sg Nom", "x ◊_∞_N Sem/Plc Sg Nom"), (3, "x ◊_∞_N Sem/Plc_Org Sg Nom", "x ◊_∞_N Sem/Plc Sem/Org Sg Nom"),
    (4, "x ◊_∞_N Sem/Group_Hum Sg Nom", "x ◊_∞_N Sem/Hum Sg Nom"), (5, "x ◊_∞_N Sem/Group Sg Nom", "x ◊_∞_N Sem/Abstr Sg Nom"), (6, "x ◊_∞_N Sem/Sport Sg", "x ◊_∞_N Sem/Act Sg"), (7, "x ◊_∞_N Sg Nom", "x ◊_∞_N Sg Nom"),
    (8, "x ◊_∞_N Sem/Money", "x ◊_∞_N Sem/Money"), (9, "x ◊_∞_N Sem/Veh Sg", "x ◊_∞_N Sem/Veh Sg"), (10, "x ◊_∞_N Sem/Ani_Group Pl", "x ◊_∞_N Sem/Ani Pl"), (11, "x ◊_∞_N Sem/Food-med Sg", "x ◊_∞_N Sem/Obj Sg"), (12, "x ◊_∞_N Sem/Dir Sg", "x ◊_∞_N Sem/Route Sg"),
]
_DERIVED = [(1, "V TV Der/NomAg N Sg Nom", "N Sg Nom_©_V TV Der/NomAg"), (2, "A Der/vuota N Sem/State Sg V Inf", "N Sem/State Sg_©_A Der/vuota"), (3, "V Inf", None), (4, "N Der/Dimin Adv ", "Adv _©_N Der/Dimin"), (5, "A Der/at Adv Sem/X", "Adv Sem/X_©_A Der/at")]
_TOKENS = [(1, 1, 1, "Mun", "mun ◊", "Pron", "Pron.Sg1", "1", "SUBJ>", "2"), (1, 1, 2, "boađán", "boahtit", "V", "V.Prs", "2", "FMV", "0"), (1, 2, 1, "dohko ◊", "dohko", "Adv", "Adv", "1", "-F<ADVL", "0"), (2, 1, 1, "ja", "ja", "CC", "CC", "", "SPRED<OBJ", "")]
_TOKEN_LINES = [(1, 1, "\nMun\tmun ◊\tPron\tPron.Sg1\t1\tSUBJ→\t2\nboađán\tboahtit\tV\tV.Prs\t2\tFMV\t0\n"), (1, 2, "\ndohko ◊\tdohko\tAdv\tAdv\t1\t-F←ADVL\t0\n"), (2, 1, "\nja\tja\tCC\tCC\t\tSPRED←OBJ\t\n")]
_UNITS = [(1, "a|b ◊|c", "x ◊\ny\n¶ z\nu\n¶\n¶\nv"), (2, "a", "x\n¶\ny"), (3, "a|b", "")]
_UNITS_SEEN = [(1, 1, "a", "x ◊\ny"), (1, 2, "b ◊", "u"), (1, 3, "c", "¶\nv"), (2, 1, "a", "x"), (3, 1, "a", "")]
_SPANS = [
    (1, 'he said "yes ◊ it is" and left', 'he said <span type="quote">"yes ◊ it is"</span> and left'), (2, "«a» b «c ◊ d»", '<span type="quote">«a»</span> b <span type="quote">«c ◊ d»</span>'), (3, 'no ◊ "a, b," here', 'no ◊ "a, b," here'),
    (4, 'x “a "bb cc" d” y', 'x <span type="quote">“a "bb cc" d”</span><span type="quote">"bb cc"</span> d” y'), (5, "", ""),
]
_EMS = [
    (1, [("em", " one", " "), ("em", "two ", None), ("em", "three", " and more")], [("em", "one two three", "  and more")]), (2, [("em", "a", " word "), ("em", "b", None)], [("em", "a", "  word "), ("em", "b", None)]),
    (3, [("em", "a", ""), ("strong", "s", ""), ("em", "b", ".")], [("em", "a", " "), ("strong", "s", ""), ("em", "b", " .")]), (4, [("em", " only ", " t")], [("em", " only ", " t")]), (5, [("em", None, None), ("em", "z", None)], [("em", "z", None)]),
]
_CARON = [(1, "c̄a  S̄\t◊ b\nʒ̄ ", "ča Š ◊ b ǯ"), (2, "Ʒ̄x ◊ C̄ s̄", "Ǯx ◊ Č š"), (3, "ā ◊ plain", "ā ◊ plain")]
_XML = [
    (1, '<document xml:lang="sme" id="x"><header><title>T</title></header><body><p type="title">Head ◊</p><p xml:lang="nob">a <errorort>bad ◊<correct>good</correct></errorort> t<hyph/>e <em>x</em></p></body></document>'),
    (2, '<document xml:lang="smj"><body><p>a<errorlex>b <errorort>c<correct>d</correct></errorort> e<correct>f ◊</correct></errorlex></p><p/><dependency><![CDATA["<a>"]]></dependency></body></document>'), (3, "no xml <"),
]
_XML_SEEN = [
    (1, "sme", 0, "title", None, "text:Head ◊"), (1, "sme", 1, None, "nob", "text:a |errorort:bad ◊>good|text: t|hyph:­|text:e |text:x"), (2, "smj", 0, None, None, "text:a|errorlex:b c e>f ◊"), (2, "smj", 1, None, None, ""),
]
_ERRORS = [
    (1, "/c/a.xml", '<document><body><p>x <errorort>bad<correct pos="n" errtype="mix">good ◊</correct></errorort> y <em><errorlex>w<correct>v</correct></errorlex></em></p></body></document>'),
    (2, "/c/b.xml", '<document><body><p><errormorphsyn cat="x">a <errorort>b ◊<correct>c</correct></errorort> d<correct cat="y">whole ◊</correct><correct>other</correct></errormorphsyn></p></body></document>'),
    (3, "c.xml", '<document><body><p>none</p></body></document>'),
]
_ERRORS_SEEN = [(1, 1, "bad\tgood ◊\t#errtype=mix,pos=n"), (1, 2, "w\tv"), (2, 1, "a c d\twhole ◊\t#cat=y\tother"), (2, 2, "b ◊\tc")]
_ERRORS_NAMED = [(1, 1, "bad\tgood ◊\t#errtype=mix,pos=n, file: a.xml")]
_GENRE = [(1, "admin", "administration"), (2, "laws", "law"), (3, "", ""), (4, None, ""), (5, "blogs", "blog"), (6, "own", "own")]


def reading_lines(spark, d):
    return dressed(spark, d, "id int, reading string, expected string", _LINES).select("id", G.one_line(F.col("reading")).alias("line"))


def semantic_classes(spark, d):
    return dressed(spark, d, "id int, reading string, expected string", _SEM).select("id", G.coarse_classes(F.col("reading")).alias("reading"))


def derivation_swap(spark, d):
    return dressed(spark, d, "id int, tags string, expected string", _DERIVED).select("id", G.swapped_derivation(F.col("tags")).alias("tags"))


def token_lines(spark, d):
    rows = dressed(spark, d, "id int, sentence_no int, position int, word string, lemma string, pos string, msd string, ref string, deprel string, dephead string", _TOKENS)
    return G.token_lines(rows, "id")


def function_labels(spark, d):
    labels = load(spark, d, "documents").select(F.element_at(F.array(*map(F.lit, G.LABELS)), (F.col("doc_id") % len(G.LABELS) + 1).cast("int")).alias("label"))
    return labels.groupBy(G.label_shown(F.col("label")).alias("label")).agg(F.count("*").alias("n"))


def genre_names(spark, d):
    return dressed(spark, d, "id int, code string, expected string", _GENRE).select("id", G.genre_shown(F.col("code")).alias("genre"))


def analysed_units(spark, d):
    return G.analysed_units(dressed(spark, d, "id int, s string, analysis string", _UNITS).withColumn("segs", F.split("s", r"\|")), "id")


def quote_marking(spark, d):
    return dressed(spark, d, "id int, text string, expected string", _SPANS).select("id", P.marked_quotes(F.col("text")).alias("text"))


def emphasis_compaction(spark, d):
    rows = dressed(spark, d, "id int, runs array<struct<tag:string,text:string,tail:string>>", [(k, r) for k, r, _ in _EMS])
    return rows.select("id", F.posexplode(P.compact_emphasis(F.col("runs"))).alias("place", "r")).select("id", "place", "r.*")


def caron_letters(spark, d):
    return dressed(spark, d, "id int, text string, expected string", _CARON).select("id", X.carons(F.col("text")).alias("text"))


def xml_paragraphs(spark, d):
    rows = G.document_paragraphs(dressed(spark, d, "id int, xml string", _XML), "id", "xml")
    shown = F.transform("runs", lambda r: F.concat(r["kind"], F.lit(":"), r["text"], F.coalesce(F.concat(F.lit(">"), r["correct"]), F.lit(""))))
    return rows.select("id", "doc_lang", "para_no", "type", "lang", F.array_join(shown, "|").alias("runs"))


def xml_projection(spark, d):
    """Paragraphs of documents written as XML, read back and printed with corrections."""
    docs = load(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[&<>]|[^\\x09\\x0A\\x20-\\uD7FF]", "").alias("t"))
    xml = F.concat(F.lit('<document xml:lang="sme"><body><p>'), F.replace("t", F.lit("\n"), F.lit("</p><p>")), F.lit(" <errorort>bad<correct>good</correct></errorort></p></body></document>"))
    paras = G.document_paragraphs(docs.select("doc_id", xml.alias("xml")), "doc_id", "xml")
    return N.project(paras, "doc_id", N.Projection(corrected=("errorort",))).select("doc_id", F.md5("text").alias("digest"))


def element_pick(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.lit("<document><body>"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("<dependency>"), F.regexp_replace("text", "[^A-Za-z0-9 ]", ""), F.lit("</dependency>"))).otherwise(""), F.lit("</body></document>")).alias("xml"))
    return docs.select("doc_id", F.md5(G.element_text(F.col("xml"), "dependency")).alias("digest"))


def error_lines(spark, d):
    return G.error_lines(dressed(spark, d, "id int, path string, xml string", _ERRORS), "id", "xml")


def error_lines_named(spark, d):
    return G.error_lines(dressed(spark, d, "id int, path string, xml string", _ERRORS), "id", "xml", ("errorort",), "path")


def relation_sentences(spark, d):
    return R.relation_sentences(R.heads_of(R.derived_sentences(load(spark, d, "documents"))))


def semantic_counts(spark, d):
    t = R.derived_tokens(load(spark, d, "documents"))
    tagged = t.withColumn("msd", F.when(F.col("position") % 5 == 0, "N.Sem_Hum.Sg").otherwise("N.Sg"))
    return R.text_counts(R.semantic_rows(tagged))


QUERIES = {
    f.__name__: f
    for f in (reading_lines, semantic_classes, derivation_swap, token_lines, function_labels, genre_names, analysed_units, quote_marking, emphasis_compaction, caron_letters, xml_paragraphs, xml_projection, element_pick, error_lines, error_lines_named, relation_sentences, semantic_counts)
}


def _seen(columns: str, rows, cases=None) -> str:
    return f"select * from {dressed_sql(columns, rows, cases)}"


ORACLE = {
    "reading_lines": _seen("id, line", [(k, e) for k, _, e in _LINES]),
    "semantic_classes": _seen("id, reading", [(k, e) for k, _, e in _SEM]),
    "derivation_swap": _seen("id, tags", [(k, e) for k, _, e in _DERIVED]),
    "token_lines": _seen("id, sentence_no, lines", _TOKEN_LINES, _TOKENS),
    "function_labels": f"select translate((string_split({values('l', [(' '.join(G.LABELS),)]).removeprefix('(values (').removesuffix(')) as t(l)')}, ' '))[doc_id % {len(G.LABELS)} + 1], '<>', '←→') as label, count(*) as n from documents group by 1",
    "genre_names": _seen("id, genre", [(k, e) for k, _, e in _GENRE]),
    "analysed_units": _seen("id, unit_no, seg, analysis", _UNITS_SEEN, _UNITS),
    "quote_marking": _seen("id, text", [(k, e) for k, _, e in _SPANS]),
    "emphasis_compaction": _seen("id, place, tag, text, tail", [(k, i, *r) for k, _, rs in _EMS for i, r in enumerate(rs)], _EMS),
    "caron_letters": _seen("id, text", [(k, e) for k, _, e in _CARON]),
    "xml_paragraphs": _seen("id, doc_lang, para_no, type, lang, runs", _XML_SEEN, _XML),
    "xml_projection": """select doc_id, md5(string_agg(regexp_replace(l, '[ ]+$', '') || ' ¶' || chr(10), '' order by n)) as digest from (
  select doc_id, generate_subscripts(ls, 1) as n, unnest(ls) as l from (select doc_id, string_split(regexp_replace(text, '[&<>]|[^\\x09\\x0A\\x20-\\x{D7FF}]', '', 'g') || ' good', chr(10)) as ls from documents)) where trim(l) <> '' group by doc_id""",
    "element_pick": "select doc_id, case when doc_id % 3 > 0 then md5(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')) end as digest from documents",
    "error_lines": _seen("id, line_no, line", _ERRORS_SEEN, _ERRORS),
    "error_lines_named": _seen("id, line_no, line", _ERRORS_NAMED, _ERRORS),
    "relation_sentences": _TOK
    + ", ok as (select * from hd where not (hword = word and hlemma = lemma) and rel <> 'X'), "
    + _CASES
    + """, i as (select head, head_lemma, dep, dep_lemma, rel, wfhead, text_id, sentence_id, position, [text_id, sentence_id, position, k] as o from cases),
m as (select head, head_lemma, dep, dep_lemma, rel, wfhead, min(o) as o from i group by all)
select i.head, i.head_lemma, i.dep, i.dep_lemma, i.rel, m.wfhead, i.text_id, i.sentence_id, i.position - 1 as "start", i.position as "end" from i join m on i.head = m.head and i.head_lemma = m.head_lemma and i.dep = m.dep and i.dep_lemma = m.dep_lemma and i.rel = m.rel and m.o <= i.o""",
    "semantic_counts": _TOK + "select text_id, count(distinct sentence_id) as sentences, (count(*) + count(*) filter (pos = 'N' and position % 5 = 0))::bigint as tokens from tok group by text_id",
}
