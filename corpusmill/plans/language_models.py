"""Queries on tokens, n-gram models and language classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import ngram
from corpusmill.sources.tables import load

_W, _C = X.WS + "+", X.split_class()


def wordcount(spark, d):
    return load(spark, d, "documents").select("doc_id", X.word_count("text").alias("words"))


def tokenise_docs(spark, d):
    return ngram.tokens(load(spark, d, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_if(F.col("token") == "").alias("empty_tokens"), F.countDistinct("token").alias("distinct_tokens"))


def token_freq(spark, d):
    return ngram.word_freq(load(spark, d, "documents"), "lang").select("lang", "token", "n")


def char_ngrams_by_lang(spark, d):
    return ngram.char_freq(load(spark, d, "documents"), "lang").select("lang", "gram", "freq")


def char_model_top400(spark, d):
    return ngram.char_model(load(spark, d, "documents"))


def word_model_invrank(spark, d):
    return ngram.word_model(load(spark, d, "documents")).withColumn("invrank", F.round("invrank", 6))


def _distances(spark, d):
    docs = load(spark, d, "documents")
    return docs, ngram.distances(docs, ngram.char_model(docs))


def lang_distance(spark, d):
    return _distances(spark, d)[1]


def lang_classify_char(spark, d):
    return ngram.classify_char(_distances(spark, d)[1])


def lang_classify_full(spark, d):
    docs, dist = _distances(spark, d)
    return ngram.classify_full(docs, dist, ngram.word_model(docs))


def lang_confusion(spark, d):
    docs = load(spark, d, "documents")
    found = lang_classify_char(spark, d)
    return docs.select("doc_id", "lang").join(found, "doc_id").groupBy("lang", "predicted").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (wordcount, tokenise_docs, token_freq, char_ngrams_by_lang, char_model_top400, word_model_invrank, lang_distance, lang_classify_char, lang_classify_full, lang_confusion)}

_TOK = f"""
pieces as (select doc_id, lang, p, generate_subscripts(p, 1) - 1 as i, unnest(p) as piece from
  (select doc_id, lang, list_filter(regexp_split_to_array(text, '{_W}'), lambda x: x <> '') as p from documents)),
toks as (select doc_id, lang, i, generate_subscripts(s, 1) - 1 as j, unnest(s) as token from
  (select doc_id, lang, i, regexp_split_to_array(piece, '{_C}') as s from pieces)),
"""


def _grams(key: str, name: str) -> str:
    return f"""
{name}_w as (select {key}, token, count(*) as n, min([doc_id, i, j]) as f from toks group by all),
{name}_s as (select {key}, n, f, '_' || token || '_' as w, unnest(range(1, length(token) + 3)) as s from {name}_w),
{name}_k as (select {key}, n, f, w, s, unnest(range(1, least(4, length(w) - s + 1) + 1)) as k from {name}_s),
{name} as (select {key}, substring(w, s, k) as gram, sum(n)::bigint as freq, min(list_concat(f, [s, k])) as f from {name}_k group by all),
{name}_r as (select * from (select {key}, gram, freq, row_number() over (partition by {key} order by freq desc, f) - 1 as rank from {name}) where rank < 400),
"""


_MODELS = "with " + _TOK + _grams("lang", "lg")
_DIST = (
    _MODELS
    + _grams("doc_id", "dg")
    + """
met as (select d.doc_id, m.lang, sum(abs(d.rank - m.rank) - 400) as gain from dg_r d join lg_r m using (gram) group by all),
cnt as (select doc_id, count(*) as grams from dg_r group by all),
dist as (select d.doc_id, l.lang, (coalesce(grams, 0) * 400 + coalesce(gain, 0))::bigint as distance
  from documents d left join cnt using (doc_id) cross join (select distinct lang from lg_r) l left join met m on m.doc_id = d.doc_id and m.lang = l.lang),
char_best as (select doc_id, arg_min(lang, [distance::varchar.lpad(20, '0'), lang]) as predicted, min(distance) as distance from dist group by doc_id),
"""
)
_WORDS = """
lw as (select lang, token, count(*) as n, min([doc_id, i, j]) as f from toks group by all),
lw_r as (select *, count(*) over (partition by lang) as size from (select lang, token, n, row_number() over (partition by lang order by n desc, f) - 1 as rank from lw) where rank < 30000 and token <> ''),
wm as (select lang, token as gram, n as freq, rank, (size - rank) / (size / 30000.0::double) as invrank from lw_r),
"""
_END = " z as (select 1) "

ORACLE = {
    "wordcount": f"select doc_id, len(list_filter(regexp_split_to_array(text, '{_W}'), lambda x: x <> '')) as words from documents",
    "tokenise_docs": "with " + _TOK + _END + "select doc_id, count(*) as tokens, count(*) filter (token = '') as empty_tokens, count(distinct token) as distinct_tokens from toks group by doc_id",
    "token_freq": "with " + _TOK + _END + "select lang, token, count(*) as n from toks group by all",
    "char_ngrams_by_lang": _MODELS + _END + "select lang, gram, freq from lg",
    "char_model_top400": _MODELS + _END + "select lang, gram, freq, rank from lg_r",
    "word_model_invrank": "with " + _TOK + _WORDS + _END + "select lang, gram, freq, rank, round(invrank, 6) as invrank from wm",
    "lang_distance": _DIST + _END + "select * from dist",
    "lang_classify_char": _DIST + _END + "select * from char_best",
    "lang_classify_full": _DIST
    + _WORDS
    + """
near as (select *, count(*) over (partition by doc_id) as kept from (select *, min(distance) over (partition by doc_id) as best from dist) where distance <= best * 1.10),
own as (select doc_id, token, count(*) as n from toks group by all),
hits as (select o.doc_id, w.lang, sum(w.invrank * w.invrank * o.n * 100) as w from own o join wm w on o.token = w.gram group by all),
sc as (select n.doc_id, n.lang, n.kept, case when kept = 1 then distance when distance <= 0 then 0 else distance - coalesce(w, 0) / distance end as score from near n left join hits using (doc_id, lang)),
fin as (select doc_id, lang, kept, row_number() over (partition by doc_id order by score, lang) as r from sc),
"""
    + _END
    + "select doc_id, lang as predicted, kept from fin where r = 1",
    "lang_confusion": _DIST + _END + "select d.lang, predicted, count(*) as n from documents d join char_best using (doc_id) group by all",
}
