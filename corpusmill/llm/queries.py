"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import (
    ann_forest,
    bpe_wordtable,
    decontam_wumanber,
    html_blstm,
    jaccard_trie,
    langid_crossparse,
    license_winnow,
    merkle_manifest,
    paragraph_minhash,
    quality_nnpu,
    simhash_popcount,
    source_divergence,
    toxicity_ftrl,
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.search(_read(spark, sf_dir, "embeddings"))


def op2_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return toxicity_ftrl.score(documents, toxicity_ftrl.train(documents, _read(spark, sf_dir, "labels"))).select("doc_id", "found.*")


def op3_langid_crossparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return langid_crossparse.predict(documents, langid_crossparse.train(documents)).select("doc_id", "found.*")


def op4_html_blstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return html_blstm.extract(pages, html_blstm.train(pages))


def op5_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_popcount.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return quality_nnpu.score(documents, quality_nnpu.train(documents, _read(spark, sf_dir, "labels"))).select("doc_id", "found.*")


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op7_decontam_wumanber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam_wumanber.annotate(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("hit.items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "hit.n_words",
        "hit.n_hit",
        F.size("hit.items").cast("long").alias("n_items"),
        _sha(F.array_join(ids, ",")).alias("items_sha256"),
        (F.col("hit.n_hit") > 0).alias("contaminated"),
    )


def op8_bpe_wordtable(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_wordtable.encode(_read(spark, sf_dir, "documents"), bpe_wordtable.Vocabulary.read(tokenizer_path()))
    return found.select("doc_id", "n_tokens", _sha(F.col("ids")).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


def op9_license_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_winnow.matches(_read(spark, sf_dir, "documents")).select("doc_id", "found.*")
    places = F.transform("matches", lambda m: F.format_string("%s[%d,%d)", m["license"], m["start"], m["end"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.array_join(places, " ").alias("spans"),
        F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("best_coverage"),
    )


def op10_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraph_minhash.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    more = ((F.col("cut.n_cut") > 0).alias("cut"), "cut.kept_in", F.length("text").cast("long").alias("n_chars_left"), _sha(F.col("text")).alias("text_sha256"))
    return found.select("doc_id", "cut.n_words", "cut.n_cut", "cut.n_spans", *more)


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_trie.similar(_read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    found = merkle_manifest.manifest(_read(spark, sf_dir, "documents"), changed={"n_chars": F.col("n_chars") + 1}, where=tampered)
    hexed = {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof": "proof_sha256", "folded": "folded_root"}
    return found.select("doc_id", *(F.lower(F.hex(c)).alias(name) for c, name in hexed.items()), "verified")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS7 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP7 = f"""
with b as (select item_id, {_WORDS7} as w from benchmark where item_id is not null),
b2 as (select item_id, w, least(len(w), 10) as n from b where len(w) > 0),
pat as (select distinct item_id, n, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') as p
        from b2, lateral (select unnest(range(1, len(w) - n + 2)) as k)),
d as (select doc_id, row_number() over () as r, {_WORDS7} as w from documents),
win as (select r, n, k, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') as p
        from d, (select distinct n from pat) s, lateral (select unnest(range(1, len(w) - n + 2)) as k)),
occ as (select win.r, win.k, win.n, pat.item_id from win join pat on win.n = pat.n and win.p = pat.p),
hit as (select r, count(distinct i) as n_hit from (select r, unnest(range(k, k + n)) as i from occ) group by r),
its as (select r, count(*) as n_items, string_agg(x, ',' order by x) as xs
        from (select distinct r, cast(item_id as varchar) as x from occ) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(xs, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join its using (r)
"""


def _h(*columns: str) -> str:
    """SQL of the digest of some fields: a dash for null, else the count of bytes, a colon and the value."""
    return "sha256(" + " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in columns) + ")"


_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, k: if(a & 1 = 1, xor(a >> 1, 3988292384::bigint), a >> 1))))"""

_OP12 = f"""
with recursive
leaf as (select row_number() over () as r, doc_id, lang, {_h("doc_id", "source", "lang", "n_chars", "text")} as leaf,
         case when {_CRC32} % 7 = 0 then {_h("doc_id", "source", "lang", "n_chars + 1", "text")} end as altered from documents),
own as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from leaf),
low as (select 0 as lvl, lang, i, n, leaf as h from own
        union all
        select lvl + 1, lang, i // 2, max((n + 1) // 2), sha256(string_agg(h, '' order by i)) from low where n > 1 group by lvl, lang, i // 2),
sub as (select lang, lvl as levels, h as subroot, row_number() over (order by lang nulls first) - 1 as j, count(*) over () as m from low where n = 1),
high as (select 0 as lvl, j, m, subroot as h from sub
         union all
         select lvl + 1, j // 2, max((m + 1) // 2), sha256(string_agg(h, '' order by j)) from high where m > 1 group by lvl, j // 2),
top as (select lvl as above, h as root from high where m = 1),
step as (select own.r, l.lvl, (own.i >> l.lvl) & 1 = 1 as on_left, s.h as sibling
         from own join sub on own.lang is not distinct from sub.lang join (select distinct lvl from low) l on l.lvl < sub.levels
         left join low s on s.lang is not distinct from own.lang and s.lvl = l.lvl and s.i = xor(own.i >> l.lvl, 1)
         union all
         select own.r, sub.levels + l.lvl, (sub.j >> l.lvl) & 1 = 1, s.h
         from own join sub on own.lang is not distinct from sub.lang join (select distinct lvl from high) l on l.lvl < (select above from top)
         left join high s on s.lvl = l.lvl and s.j = xor(sub.j >> l.lvl, 1)),
fold as (select r, 0 as lvl, coalesce(altered, leaf) as h from own
         union all
         select fold.r, fold.lvl + 1, sha256(case when on_left then coalesce(sibling, '') || h else h || coalesce(sibling, '') end)
         from fold join step on step.r = fold.r and step.lvl = fold.lvl),
last as (select r, arg_max(h, lvl) as folded_root from fold group by r),
prf as (select r, string_agg(sibling, '' order by lvl) as p from step group by r)
select doc_id, leaf, subroot, root, sha256(coalesce(p, '')) as proof_sha256, folded_root, folded_root = root as verified
from own join sub on own.lang is not distinct from sub.lang cross join top join last using (r) left join prf using (r)
"""


_P = "1 + 1000000000 * ({n}::hugeint + 1) // ({total} + v)"
_F = "({p} - {q}) * ({p} - {q}) // {q}"

_OP13 = f"""
with docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
words as (select r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from docs),
kept as (select lang, term, count(*) as n from words group by lang, term having count(distinct r) >= 3),
langs as (select lang, sum(n) as total, count(*) as v from kept group by lang),
grp as (select distinct lang, source from docs),
cnt as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
sums as (select lang, source, sum(n) as total from cnt group by all),
own as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, {_P.format(n="coalesce(c.n, 0)", total="coalesce(s.total, 0)")} as p,
        {_P.format(n="k.n", total="l.total")} as q
        from grp g join kept k using (lang) join langs l using (lang) left join sums s using (lang, source) left join cnt c using (lang, source, term)),
met as (select a.lang, a.source, b.source as item, sum({_F.format(p="a.p", q="b.p")}) as value
        from own a join own b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(m.value, 0) as bigint) as value
         from grp a join grp b on a.lang = b.lang and a.source <> b.source left join met m on m.lang = a.lang and m.source = a.source and m.item = b.source),
term as (select lang, source, 'term' as part, term as item, cast({_F.format(p="p", q="q")} as bigint) as value from own where n > 0 and p > q)
select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (from pair union all from term)
qualify part = 'pair' or rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_decontam_wumanber": _OP7, "op12_merkle_manifest": _OP12, "op13_source_divergence": _OP13}
