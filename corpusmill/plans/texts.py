"""Queries on lines, paragraphs, sentences and text repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import dates
from corpusmill.functions import text as X
from corpusmill.operators import paragraphs as P
from corpusmill.sources.literals import dressed, dressed_sql, values
from corpusmill.sources.tables import load

_W = X.WS + "+"
_GARBLED = [
    (1, "sme", "mii l‡hkit  ◊"), (2, "mhr", "ìò kala  ◊"), (3, "mrj", "àûtext  ◊"), (4, "sme", "a\x8cb  ◊"), (5, "sme", "³x¢y¤z  ◊"), (6, "sme", "áb ªc  ◊"), (7, "sme", "ó ç ð  ◊"), (8, "sme", "á è ð  ◊"),
    (9, "sme", "ó ç ¤  ◊"), (10, "sme", "„a ¹  ◊"), (11, "sme", "þ š á  ◊"), (12, "sme", "Ã¡bc  ◊"), (13, "sme", "clean text  ◊"), (14, "sme", "x\x87 ã  ◊"), (15, "sme", "á¯  ◊"), (16, "sme", "Œ ÄŒ  ◊"),
]
_FIXES = [
    (1, "sms", "mu’st ʼ ´x ʹ y'z ◊ ﬁ "), (2, "mns", "ab ◊ ﬁ "), (3, "sme", "[scaron] [eng ]x ﬁn ﬂy o\x9eo ď \x03z ◊ ﬁ "), (4, "sme", "ﬃ ﬄ\x1e [dstrok]a ◊ ﬁ "), (5, "nob", "plain ◊ ﬁ "), (6, "sme", "a­b­c ◊ ﬁ "),
]
_PLAIN = [(1, "aÊÊb\r\nc\r◊ d<*B>e\x07"), (2, "<0x010C>akki <0x2003>◊ x\n\n\n# note\ny"), (3, "=" * 80 + "end ◊\x0b"), (4, "\n◊\n \n")]
_QUOTED = [(1, 'he said "yes ◊ it is" and left'), (2, "«a» b «c ◊ d» e"), (3, "“one” and “two ◊”"), (4, "”left ◊ it be” x"), (5, '◊ no "a, b," here')]
_NEWS = [
    (1, "@tittel: Head"), (2, "@ingress: In short"), (3, "byline: Some One"), (4, "plain line"), (5, "@m.titt: Between"), (6, "@bold: dark"), (7, "  @foto: By me"), (8, "Undertittel: Below"), (9, "tittel: bilde 3: x"),
    (10, "@kursiv: skew"), (11, "@BOLD: no"), (12, "@Hovedtittel: Main"), (13, "LEDtekst: caption"), (14, "mellomtittel: x"), (15, "\u00a0@bildetekst: y"), (16, "stikk: s"), (17, "tit: t"),
]
_NEWS_SEEN = [
    (1, "headertitle", "Head"), (2, "text", "In short"), (3, "byline", "Some One"), (4, None, "plain line"), (5, "title", "Between"), (6, "bold", "dark"), (7, None, "@foto: By me"), (8, "title", "Below"), (9, "text", "x"),
    (10, "italic", "skew"), (11, None, "@BOLD: no"), (12, "headertitle", "Main"), (13, "text", "caption"), (14, "title", "x"), (15, "text", "y"), (16, "title", "s"), (17, "title", "t"),
]
_YEARS = [(1, None), (2, "unknown"), (3, "2018"), (4, "2011-2012"), (5, "5.10.2004"), (6, "18"), (7, "05.10.2004")]
_RANGES = [(1, "1"), (2, "1,4-6"), (3, "3, 9-11, 4"), (4, "")]
_MSD = [(1, "N", "Sg Nom"), (2, "V", "TV Ind Prs Sg3"), (3, "Pron", "Relc Sg Nom"), (4, "N", "___"), (5, "A", "Dyn/x Known y"), (6, "V", " IV Inf ")]
_VARIANTS = [(1, "mhr", 1920), (2, "mhr", 1939), (3, "mrj", 1950), (4, "mrj", 1995), (5, "sme", 1920), (6, "mrj", None), (7, "mhr", 1909)]
_SIZES = [(1, 10), (2, 1024), (3, 1536), (4, 5 * 1024**2), (5, 3 * 1024**3 + 1)]
_PAGES = [(1, "◊ mannan-", "◊ duv"), (2, "Kárá-", "◊ Johka"), (3, "word ◊", "next"), (4, "2004-", "◊ 2005")]


def paragraphs(spark, d):
    return P.paragraphs(P.lines(load(spark, d, "documents"), "doc_id"), "doc_id").select("doc_id", "para_no", "text")


def plaintext_paragraphs(spark, d):
    cleaned = dressed(spark, d, "id int, text string", _PLAIN).withColumn("text", P.clean_plain(F.col("text")))
    return P.paragraphs(P.lines(cleaned, "id"), "id").select("id", "para_no", "text")


def skip_lines(spark, d):
    rows = P.lines(load(spark, d, "documents"), "doc_id")
    return P.skip_lines(rows, dates.number_ranges(F.lit("1,3-4"))).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def sentence_split(spark, d):
    return P.sentences(P.tokens(load(spark, d, "documents"), "doc_id"), "doc_id")


def conversation_sentences(spark, d):
    rows = load(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    return P.sentences(P.tokens(rows, "key"), "key").groupBy("key.conv_id", "key.turn").agg(F.count("*").alias("sentences"), F.sum(F.length("sentence")).alias("chars"))


def control_strip(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(X.strip_controls("text", c1=True)).alias("digest"))


def encoding_guess(spark, d):
    garbled = dressed(spark, d, "id int, lang string, text string", _GARBLED)
    return garbled.select("id", X.guess_encoding(F.col("text"), F.col("lang")).alias("encoding"))


def encoding_guess_docs(spark, d):
    return load(spark, d, "documents").select(X.guess_encoding(F.col("text"), F.col("lang")).alias("encoding")).groupBy("encoding").agg(F.count("*").alias("n"))


def text_fixes(spark, d):
    rows = dressed(spark, d, "id int, lang string, text string", _FIXES)
    return rows.select("id", X.fix_ligatures(F.col("text")).alias("ligatures"), X.fix_bad_unicode(F.col("text")).alias("unicode"), X.fix_language(F.col("text"), "lang").alias("language"), X.soft_hyphens(F.col("text"), "xml").alias("hyphens"))


def ligature_fix_docs(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(X.fix_bad_unicode(X.fix_ligatures(F.col("text")))).alias("digest"))


def replacement_table(spark, d):
    """Documents under a chain of replacements: every word of the documents of thirteen letters becomes another, in the order of the alphabet."""
    docs = load(spark, d, "documents")
    words = docs.select(F.explode(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " "), " ")).alias("w")).where("length(w) = 13").distinct()
    pairs = words.select(F.col("w").alias("place"), F.col("w").alias("wrong"), F.concat(F.substring("w", 4, 3), F.substring("w", 1, 2)).alias("right"))
    return docs.select("doc_id", F.md5(X.replaced_by_table(F.col("text"), pairs)).alias("digest"))


def quote_spans(spark, d):
    docs = dressed(spark, d, "id bigint, text string", _QUOTED)
    return P.quotes(docs, "id").groupBy("id", "quote").agg(F.count("*").alias("n"))


def quote_spans_docs(spark, d):
    return P.quotes(load(spark, d, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("quotes"), F.sum(F.length("quote")).alias("chars"))


def newstag_lines(spark, d):
    rows = dressed(spark, d, "id int, line string", _NEWS)
    return rows.select("id", P.news_tag(F.col("line")).alias("kind"), P.without_news_tag(F.col("line")).alias("rest"))


def year_normalise(spark, d):
    return dressed(spark, d, "id int, year string", _YEARS).select("id", dates.year_struct(F.col("year")).alias("y")).select("id", "y.*")


def analyser_variant(spark, d):
    return dressed(spark, d, "id int, lang string, year int", _VARIANTS).select("id", dates.analyser_variant(F.col("lang"), F.col("year")).alias("variant"))


def skip_ranges(spark, d):
    return dressed(spark, d, "id int, v string", _RANGES).select("id", F.array_join(dates.number_ranges(F.col("v")), ",").alias("numbers"))


def msd_clean(spark, d):
    return dressed(spark, d, "id int, pos string, msd string", _MSD).select("id", dates.clean_msd(F.col("msd"), F.col("pos")).alias("msd"))


def human_sizes(spark, d):
    return dressed(spark, d, "id int, n bigint", _SIZES).select("id", X.human_size(F.col("n")).alias("size"))


def page_joins(spark, d):
    return dressed(spark, d, "id int, a string, b string", _PAGES).select("id", P.page_join(F.col("a"), F.col("b")).alias("joined"))


QUERIES = {
    f.__name__: f
    for f in (paragraphs, plaintext_paragraphs, skip_lines, sentence_split, conversation_sentences, control_strip, encoding_guess, encoding_guess_docs, text_fixes, replacement_table, ligature_fix_docs, quote_spans, quote_spans_docs, newstag_lines, year_normalise, analyser_variant, skip_ranges, msd_clean, human_sizes, page_joins)
}


def _q(s: str) -> str:
    return values("x", [(s,)]).removeprefix("(values (").removesuffix(")) as t(x)")


def _chain(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {_q(a)}, {_q(b)})"
    return expr


def _islands(source: str, key: str) -> str:
    return f"""select {key}, row_number() over (partition by {key} order by island) as para_no, text from (
  select {key}, island, string_agg(line, chr(10) order by line_no) as text from (
    select *, sum(blank::int) over (partition by {key} order by line_no) as island from (
      select *, regexp_full_match(line, '{X.WS}*') as blank from (
        select {key}, generate_subscripts(l, 1) as line_no, unnest(l) as line from (select {key}, string_split(text, chr(10)) as l from {source})))) where not blank group by {key}, island)"""


_NOT = X.WS[1:-1]
_TOKENS = rf"\.+|[;!?¶…]|{X.WS}+|[^;!?.¶…{_NOT}]+"


def _sents(source: str, key: str) -> str:
    return f"""select {key}, row_number() over (partition by {key} order by island) as sentence_no, sentence from (
  select {key}, island, array_to_string(list_filter(regexp_split_to_array(string_agg(case when token = '¶' then '' else token end, '' order by pos), '{_W}'), lambda x: x <> ''), ' ') as sentence from (
    select *, coalesce(sum((token in (';', '!', '?', '.', '..', '...', '¶', '…'))::int) over (partition by {key} order by pos rows between unbounded preceding and 1 preceding), 0) as island from (
      select {key}, generate_subscripts(t, 1) as pos, unnest(t) as token from (select {key}, regexp_extract_all(text, '{_TOKENS}') as t from {source}))) group by {key}, island) where sentence <> ''"""


def _encoding() -> str:
    has = lambda *m: " and ".join(f"contains(text, {_q(x)})" for x in m)
    no = lambda x: f"not contains(text, {_q(x)})"
    cyr = "lang in ('mhr', 'mrj')"
    rules = [
        (f"{has('ì', 'ò')} and {cyr}", "cyrillic_in_pdf"), (f"{has('à', 'û')} and {cyr}", "cp1251_cp1252"),
        (f"({has('‡')} and {no('ã')}) or ({has('Œ')} and {no('ÄŒ')} and {no('å')})", "mac-sami_to_cp1252"),
        (f"({has(chr(0x87))} and {no('ã')}) or {has(chr(0x8C))} or ({has('¯')} and {no('á')})", "mac-sami_to_latin1"),
        (has(chr(0x87)), "mix-mac-sami-and-some-unknown-encoding"), (has("³", "¢", "¤"), "iso-ir-197_to_cp1252"), (f"{has('á')} and ({has('ª')} or {has('∫')})", "mac-sami_to_mac"),
        (has("ó", "ç", "ð"), "winsam_to_cp1252"), (has("á", "è", "ð"), "latin4_to_cp1252"), (has("ó", "ç", "¤"), "mix-of-latin4-and-iso-ir-197_to_cp1252"),
        (f"{has('„')} and ({has('˜')} or {has('¹')})", "winsami2_to_cp1252"), (has("þ", "š", "á"), "finnish-lawtexts-in-pdf"), (has("Ã¡"), "double-utf8"),
    ]
    return "case " + " ".join(f"when {t} then '{n}'" for t, n in rules) + " end"


_LIG = [p for k, v in X.LIGATURES for p in ((k + " ", v), (k, v))]
_SMS = f"regexp_replace({_chain('text', X.LANGUAGE_FIXES['sms'])}, '{_W}([ʼʹ])', '\\1', 'g')"


def _quotes(source: str, key: str) -> str:
    alls = " || ".join(f"regexp_extract_all(text, {_q(P.quote_pattern(*q))})" for q in P.QUOTES)
    return f"select {key}, unnest({alls}) as quote from {source}"


ORACLE = {
    "paragraphs": _islands("documents", "doc_id"),
    "plaintext_paragraphs": _islands(f"(select id, regexp_replace({_chain(_chain('text', [(chr(13) + chr(10), chr(10))]), P.PLAIN_TEXT_MARKS)}, '[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F\\x7F]', '', 'g') as text from {dressed_sql('id, text', _PLAIN)})", "id"),
    "skip_lines": "select doc_id, count(*) as lines, sum(length(line))::bigint as chars from (select doc_id, generate_subscripts(l, 1) as n, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)) where n not in (1, 3, 4) or line like '#%' group by doc_id",
    "sentence_split": _sents("documents", "doc_id"),
    "conversation_sentences": f"select key.conv_id as conv_id, key.turn as turn, count(*) as sentences, sum(length(sentence))::bigint as chars from ({_sents('(select struct_pack(conv_id := conv_id, turn := turn) as key, text from conversations)', 'key')}) group by all",
    "control_strip": r"select doc_id, md5(regexp_replace(text, '[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F\x{80}-\x{9f}]', '', 'g')) as digest from documents",
    "encoding_guess": f"select id, {_encoding()} as encoding from {dressed_sql('id, lang, text', _GARBLED)}",
    "encoding_guess_docs": f"select {_encoding()} as encoding, count(*) as n from documents group by 1",
    "text_fixes": f"select id, {_chain('text', _LIG)} as ligatures, {_chain('text', X.BAD_UNICODE)} as unicode, case lang when 'sms' then {_SMS} when 'mns' then {_chain('text', X.LANGUAGE_FIXES['mns'])} else text end as language, replace(text, '­', '<hyph/>') as hyphens from {dressed_sql('id, lang, text', _FIXES)}",
    "ligature_fix_docs": f"select doc_id, md5({_chain(_chain('text', _LIG), X.BAD_UNICODE)}) as digest from documents",
    "replacement_table": """with w as (select distinct unnest(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g'), ' ')) as w from documents),
p as (select list(w order by w) as ws from w where length(w) = 13)
select doc_id, md5(list_reduce(list_prepend(text, ws), lambda t, x: replace(t, x, x[4:6] || x[1:2]))) as digest from documents, p""",
    "quote_spans": f"select id, quote, count(*) as n from ({_quotes(dressed_sql('id, text', _QUOTED), 'id')}) group by all",
    "quote_spans_docs": f"select doc_id, count(*) as quotes, sum(length(quote))::bigint as chars from ({_quotes('documents', 'doc_id')}) group by doc_id",
    "newstag_lines": f"select * from {dressed_sql('id, kind, rest', _NEWS_SEEN, _NEWS)}",
    "year_normalise": r"""select id, case k when 1 then year || '-01-01' when 2 then p[1] || '-01-01' when 3 then d[3] || '-' || d[2] || '-' || d[1] else '0000-00-00' end as date,
  case k when 1 then year || '0101' when 2 then p[1] || '0101' when 3 then d[3] || d[2] || d[1] else '00000000' end as datefrom,
  case k when 1 then year || '0101' when 2 then p[2] || '0101' when 3 then d[3] || d[2] || d[1] else '00000000' end as dateto
  from (select id, year, string_split(year, '-') as p, string_split(year, '.') as d,
    case when regexp_full_match(year, '[0-9]{4}') then 1 when regexp_full_match(year, '[0-9]{4}-[0-9]{4}') then 2 when regexp_full_match(year, '[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}') then 3 end as k from """
    + dressed_sql("id, year", _YEARS)
    + ")",
    "analyser_variant": f"select id, case when lang in ('mhr', 'mrj') and year > 1909 and year < 1939 then 'korp-analyser-thirties' when lang = 'mrj' and year > 1939 and year < 1995 then 'korp-analyser-eighties' else 'korp-analyser' end as variant from {dressed_sql('id, lang, year', _VARIANTS)}",
    "skip_ranges": f"""select id, coalesce(string_agg(n, ',' order by n), '') as numbers from (
  select distinct id, n from (select id, unnest(range(string_split(trim(x), '-')[1]::int, string_split(trim(x), '-')[-1]::int + 1)) as n from (select id, unnest(string_split(v, ',')) as x from {dressed_sql("id, v", _RANGES)}) where trim(x) <> ''))
  right join (select id from {dressed_sql("id, v", _RANGES)}) using (id) group by id""",
    "msd_clean": "select id, case when c = '___' then pos else pos || '.' || c end as msd from (select id, pos, regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(trim(msd), 'IV[ \\t\\n]', '', 'g'), 'TV[ \\t\\n]', '', 'g'), 'Relc', 'Rel'), 'Dyn', ''), 'Known', ''), '/', '_'), '[ \\t\\n]', '.', 'g') as c from " + dressed_sql("id, pos, msd", _MSD) + ")",
    "human_sizes": "select id, case when n >= 1099511627776 then printf('%.1f TiB', n / 1099511627776.0::double) when n >= 1073741824 then printf('%.1f GiB', n / 1073741824.0::double) when n >= 1048576 then printf('%.1f MiB', n / 1048576.0::double) when n >= 1024 then printf('%.1f KiB', n / 1024.0::double) else n || ' B' end as size from " + dressed_sql("id, n", _SIZES),
    "page_joins": "select id, case when regexp_matches(a, '\\p{L}-$') and regexp_matches(b, '^\\p{Ll}') then a[:-2] || b when a like '%-' then a || b else a || ' ' || b end as joined from " + dressed_sql("id, a, b", _PAGES),
}
