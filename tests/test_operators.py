"""Operators against small hand-made cases."""

import difflib

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import dates, encodings
from corpusmill.functions import text as X
from corpusmill.operators import alignment, annotations, catalogue, duplicates, ngram, pages, printed, readings, relations
from corpusmill.plans import corpus
from corpusmill.sources import formats, reader, tables
from corpusmill.streaming import ingest


def test_tokens_keep_empty_ones(spark):
    docs = spark.createDataFrame([(1, "a.b, c"), (2, ""), (3, "  ")], "doc_id bigint, text string")
    got = {k: [r["token"] for r in ngram.tokens(docs, "doc_id").orderBy("i", "j").collect() if r["doc_id"] == k] for k in (1, 2, 3)}
    assert got == {1: ["a", "b", "", "c"], 2: [], 3: []}


def test_char_model_counts_grams_of_padded_tokens(spark):
    docs = spark.createDataFrame([(1, "aa a", "x")], "doc_id bigint, text string, lang string")
    freq = {r["gram"]: r["freq"] for r in ngram.char_freq(docs, "lang").collect()}
    assert freq == {"_": 4, "_a": 2, "_aa": 1, "_aa_": 1, "a": 3, "aa": 1, "aa_": 1, "a_": 2, "_a_": 1}


def test_distance_of_a_text_to_its_own_model_is_zero(spark):
    docs = spark.createDataFrame([(1, "one two three two", "x"), (2, "drei zwei eins", "y"), (3, None, None)], "doc_id bigint, text string, lang string")
    model = ngram.char_model(docs.where("lang is not null"))
    best = {r["doc_id"]: (r["predicted"], r["distance"]) for r in ngram.classify_char(ngram.distances(docs, model)).collect()}
    assert best[1] == ("x", 0) and best[2] == ("y", 0) and best[3] == ("x", 0)


def test_ranges_refuse_both_parities(spark):
    row = spark.range(1).select(dates.number_ranges(F.lit("odd, 2-4"), parity=True).alias("x")).first()
    assert row["x"] == [2, 3, 4]
    with pytest.raises(Exception, match="odd and even"):
        spark.range(1).select(dates.number_ranges(F.lit("odd,even"), parity=True)).collect()


def test_margins_prefer_the_page(spark):
    own = F.create_map(F.lit("3"), F.lit(9), F.lit("even"), F.lit(4))
    got = [r[0] for r in spark.range(2, 6).select(dates.margin_of(F.col("id"), own, 7)).collect()]
    assert got == [4, 9, 4, 7]


def test_crop_keeps_whole_characters(spark):
    got = spark.createDataFrame([("áčđ",), ("abc",)], "t string").select(X.crop_bytes(F.col("t"), 3)).collect()
    assert [r[0] for r in got] == ["á", "abc"]


def test_styles(spark):
    assert spark.range(1).select(dates.style_map(F.lit("top:10px;left: 5px;"))).first()[0] == {"top": "10", "left": "5"}


def test_markup_nests_and_refuses():
    s = annotations.parse_markup("x {y {z}${zz} w}£{i|whole///other} t")
    assert s.text(False) == "x y z w t" and s.text(True) == "x whole t"
    assert s.errors[0].info == "i" and s.errors[0].suggestions == ("whole", "other") and s.errors[0].errors[0].kind == "errorort"
    for bad in ("{a}#{b}", "{a", "{a}${b", "{a}$b"):
        with pytest.raises(ValueError):
            annotations.parse_markup(bad)


_COHORTS = [
    (1, "sme", '"<Mun>"\n\t"mun" Pron Sem/Hum Pers Sg1 Nom @SUBJ> #1->2\n: \n"<boađán>"\n\t"boahtit" <mv> V IV Ind Prs Sg1 @FMV #2->0\n\t"boahtit" Err/Orth V TV Inf @FMV #2->0\n"<.>"\n\t"." CLB #3->2\n\n"<¶>"\n\t"¶" CLB\n'),
    (2, "smj", '"<guolle>"\n\t"guolle" N Sem/Ani Sg Nom <W:0.0> @SUBJ> #1->2\n"<xyz>"\n\t"xyz" ? @X #2->0\n"<.>"\n\t"." CLB #3->2\n'),
    (3, "sme", ""),
]
_COHORTS_SEEN = [
    (1, 1, 1, "Mun", "mun", "Pron", "Pron.Sem_Hum.Pers.Sg1.Nom", "1", "SUBJ>", "2"), (1, 1, 2, "boađán", "boahtit", "V", "V.Ind.Prs.Sg1", "2", "FMV", "0"), (1, 1, 3, ".", ".", "CLB", "CLB", "3", "X", "2"),
    (2, 1, 1, "guolle", "guolle", "N", "N.Sg.Nom", "1", "SUBJ>", "2"), (2, 1, 2, "xyz", "xyz", "___", "___", "2", "X", "0"), (2, 1, 3, ".", ".", "CLB", "CLB", "3", "X", "2"),
]
_SENTENCES_SEEN = [(1, 1, "Mun boađán."), (4, 1, "Girji: Stuoris"), (4, 2, "lea buorre!")]
_SPACED = [
    (4, "sme", '"<Girji>"\n\t"girji" N Sg Nom #1->0\n"<:>"\n\t":" CLB #2->1\n: \n"<Stuoris>"\n\t"stuoris" A Attr #3->1\n: \n"<¶>"\n\t"¶" CLB #4->1\n:\\n\n"<lea>"\n\t"leat" V Prs Sg3 #5->0\n: \n"<buorre>"\n\t"buorre" A Sg Nom #6->5\n"<!>"\n\t"!" CLB #7->5\n'),
    (5, "sme", '"<12>"\n\t"12" Num #1->0\n"<.>"\n\t"." CLB #2->1\n: \n"<Dát>"\n\t"dát" Pron #1->0\n:odd text\n"<.>"\n\t"." CLB #2->1\n'),
]


def test_analyses_read_by_hand(spark):
    """Rows written out from the rules."""
    docs = spark.createDataFrame(_COHORTS + _SPACED, "id int, lang string, dependency string")
    got = {tuple(r) for r in annotations.parse_analysis(docs.where("id < 4"), "id").collect()}
    assert got == set(_COHORTS_SEEN)
    assert {tuple(r) for r in annotations.known_sentences(docs, "id").collect()} == {(1, 1, "Mun boađán."), (4, 1, "Girji: Stuoris"), (4, 2, "lea buorre!")}


def test_token_table_of_odd_analyses(spark):
    texts = {
        1: '"<go>"\n\t"a" N Err/Orth Sg\n\t"go" N Sg\n', 2: '"<¶>"\n\t"¶" CLB\n', 3: None, 4: '"<x>"\n', 5: ': \n"<a>"\n\t"<" PUNCT #1->0\n: \n\n"<b>"\n\t"b" #1->0\n', 6: '"<p>"\n\t"p" V Ex/N Der N Sg @X> #1->2\n\n"<¶>"\n\t"¶" CLB\n\n"<q>"\n\t"q" N Sem/Food-med Sg #1->0',
    }
    docs = spark.createDataFrame([(k, "sme", t) for k, t in texts.items()], "id int, lang string, dependency string")
    got = {tuple(r) for r in annotations.parse_analysis(docs, "id").collect()}
    assert got == {
        (1, 1, 1, "go", "go", "N", "N", "", "X", ""), (4, 1, 1, "x", "", "___", "___", "", "X", ""), (5, 1, 1, "a", "<", "PUNCT", "PUNCT", "1", "X", "0"), (5, 2, 1, "b", "b", "#", "#", "1", "X", "0"),
        (6, 1, 1, "p", "p", "N", "N.Sg", "1", "X>", "2"), (6, 2, 1, "q", "q", "N", "N.Sem_Obj.Sg", "1", "X", "0"),
    }



def test_alignment_finds_merges():
    a = ["This is the first sentence.", "Short.", "And here comes the third one, longer."]
    b = ["This is the first sentence. Short.", "And here comes the third one, longer."]
    assert alignment.align_lists(a, b) == [([0, 1], [0]), ([2], [1])]
    assert alignment.align_lists([], ["x"]) == [([], [0])] and alignment.align_lists([], []) == []


def test_every_exchange_is_aligned(spark, tmp_path):
    rows = [(1, 0, "user", "One two. Three."), (1, 1, "assistant", "Four. Five six."), (1, 2, "user", "Later one."), (1, 3, "assistant", "Later answer."), (1, 4, "user", "Left alone.")]
    rows += [(2, 0, "system", "Be brief."), (2, 1, "user", "Why?"), (2, 2, "assistant", "So."), (2, 3, "user", "And then? Well."), (2, 4, "assistant", "Then this. Good.")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = []
    for conv, no, a, b in [(1, 0, ["One two.", "Three."], ["Four.", "Five six."]), (1, 1, ["Later one."], ["Later answer."]), (1, 2, ["Left alone."], []), (2, 0, ["Why?"], ["So."]), (2, 1, ["And then?", "Well."], ["Then this.", "Good."])]:
        beads = alignment.align_lists(a, b)
        want += [(conv, no, n, " ".join(a[i] for i in p), " ".join(b[j] for j in q)) for n, (p, q) in enumerate(beads, 1)]
    assert sorted(map(tuple, corpus.sentence_align(spark, str(tmp_path)).collect())) == want


def test_near_duplicates_equal_all_pairs(spark):
    texts = ["one two three four five six", "one two three four five sixth", "something else is written here now", "one two three four five six", "", "one two three four five seven"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "doc_id bigint, text string")
    got = {(r["a"], r["b"]): r["ratio"] for r in duplicates.near_duplicates(docs).collect()}
    first = {t: k for k, t in reversed(list(enumerate(texts))) if t.split()}
    ids = sorted(first.values())
    want = {}
    for i in ids:
        for j in ids:
            n, m = len(texts[i].split()), len(texts[j].split())
            r = difflib.SequenceMatcher(None, texts[i], texts[j]).ratio()
            if i < j and min(n, m) / max(n, m) > 0.9 and r > 0.9:
                want[i, j] = r
    assert got == want and want


def test_keep_one_prefers_parallels(spark):
    docs = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, "a", 2), (4, "b", 0)], "doc_id bigint, text string, p int")
    assert {(r["kept"], r["dropped"]) for r in duplicates.keep_one(docs, "p").collect()} == {(3, 2), (4, 0)}


def test_relations_of_inflected_words(spark):
    t = spark.createDataFrame([(1, 1, 1, "Dogs", "dog", "N", 0, "X"), (1, 1, 2, "ran", "run", "V", 1, "S")], "text_id int, sentence_id int, position int, word string, lemma string, pos string, dephead int, deprel string")
    got = {(r["head"], r["dep"], r["wfhead"], r["freq"]) for r in relations.relation_freq(relations.with_heads(t)).collect()}
    assert got == {("dog", "ran", False, 1), ("Dogs", "run", True, 1)}


def test_relations_equal_plain_counting(spark):
    """Inflected and base forms at random, so that keys have both forms and flags that differ; head and dependent in any order of places."""
    import random
    from collections import defaultdict

    r, forms = random.Random(7), [("Dogs", "dog"), ("dog", "dog"), ("Dog", "dog"), ("ran", "run"), ("run", "run"), ("Run", "run"), ("run", "ran")]
    rows, seen, listed, mixed = [], {}, set(), 0
    for text in range(40):
        n = r.randint(1, 8)
        words = [(*r.choice(forms), r.choice("ST"), r.randrange(0, n + 1)) for _ in range(n)]
        rows += [(text, 1, k, w, lemma, "N", head, rel) for k, (w, lemma, rel, head) in enumerate(words, 1)]
    insertions = defaultdict(list)
    at = {(t, p): (w, lemma) for t, _, p, w, lemma, *_ in rows}
    for t, _, p, w, lemma, _, head, rel in sorted(rows):
        if not head or at[t, head] == (w, lemma):
            continue
        hw, hl = at[t, head]
        hbase, dbase = hw.lower() == hl.lower(), w.lower() == lemma.lower()
        if not hbase and not dbase:
            made = [(hl, w, True, False, False, True), (hw, lemma, False, True, True, False)]
        else:
            made = [(hl if hbase and dbase else hw, lemma, hbase, True, True, dbase)]
        for k, (h, d, bfh, bfd, wfh, wfd) in enumerate(made):
            insertions[h, hl, d, lemma, rel].append(((t, p, k), wfh, (bfh, bfd, wfd)))
    for key, found in insertions.items():
        for wfh in {f for _, f, _ in found}:
            own = sorted(x for x in found if x[1] == wfh)
            seen[(*key, wfh)] = (len(own), *own[0][2])
            listed |= {(*key, wfh, t, p - 1, p) for (t, p, k), _, _ in found if (t, p, k) >= own[0][0]}
            mixed += len({f[2] for _, _, f in own}) > 1
    tokens = spark.createDataFrame(rows, "text_id int, sentence_id int, position int, word string, lemma string, pos string, dephead int, deprel string")
    heads = relations.with_heads(tokens)
    key = ["head", "head_lemma", "dep", "dep_lemma", "rel", "wfhead"]
    assert {tuple(x[c] for c in key): tuple(x[c] for c in ("freq", "bfhead", "bfdep", "wfdep")) for x in relations.relation_freq(heads).collect()} == seen
    assert {tuple(x[c] for c in [*key, "text_id", "start", "end"]) for x in relations.relation_sentences(heads).collect()} == listed
    assert mixed  # flags that the first insertion decides


def test_derived_sentences_need_no_shuffle(spark, sf_dir):
    """Heads and token texts of derived tokens come out of a document's own row, and are those of the token table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).localCheckpoint()
    tokens = relations.derived_tokens(docs)
    heads = relations.heads_of(relations.derived_sentences(docs))
    assert sorted(map(tuple, heads.collect())) == sorted(map(tuple, relations.with_heads(tokens).collect()))
    seven = tokens.select("text_id", "sentence_id", "position", "word", "lemma", "pos", F.col("pos").alias("msd"), F.col("ref").cast("string").alias("ref"), "deprel", F.col("dephead").cast("string").alias("dephead"))
    texts = formats.vrt_of(relations.derived_texts(docs, "lang"), ("lang",))
    assert sorted(map(tuple, texts.collect())) == sorted(map(tuple, formats.vrt_texts(seven, docs.select(F.col("doc_id").alias("text_id"), "lang")).collect()))
    for made in (heads, texts, relations.relation_sentences(heads)):
        assert "Exchange hash" not in made._jdf.queryExecution().executedPlan().toString()


def test_names():
    assert pages.ascii_name("_-Čáhppes (guolli)+x.TXT") == "cahppes_guolli_x.txt"


def test_readers(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert [tuple(r) for r in tables.model_rows(lines("ab\t3", "", "c\t1")).collect()] == [("ab", 3), ("c", 1)]
    with pytest.raises(Exception, match="two columns"):
        tables.model_rows(lines("abc")).collect()
    assert [tuple(r) for r in tables.anchor_pairs(lines("# x/y", "a / b ", "c/", "d/e/f"), 2, 0, 1).collect()] == [("a", "b")]
    typos = spark.createDataFrame([("a\tb", 1), ("a\tc", 2), ("d\td", 3), ("e", 4)], "value string, k int")
    assert [tuple(r) for r in tables.typo_pairs(typos, "k").collect()] == [("a", "c")]


def test_distances_inside_rows_equal_joins(spark, sf_dir):
    from corpusmill.operators import ngram

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").where("doc_id % 5 = 0")
    docs = docs.union(spark.createDataFrame([(10_001, "x", None), (10_002, "x", ""), (10_003, "x", "a\u00a0b-c 1\u2003d")], docs.schema))
    model = ngram.char_model(docs)
    assert sorted(ngram.distances(docs, model).collect()) == sorted(ngram.joined_distances(docs, model).collect())


def test_rank_limit_reaches_the_sort(spark, sf_dir):
    from corpusmill.operators import ngram

    plan = ngram.char_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_a_file_without_status_is_an_error(spark):
    files = spark.createDataFrame([("a", "standard"), ("b", None)], "path string, status string")
    with pytest.raises(Exception, match="no conversion status: b"):
        catalogue.convertable(files, False).collect()


def test_unknown_labels_and_markers_are_errors(spark):
    with pytest.raises(Exception, match="unknown label: ODD"):
        spark.createDataFrame([("ODD",)], "x string").select(readings.label_shown(F.col("x"))).collect()
    with pytest.raises(Exception, match="unknown marker q9"):
        formats.sfm_paragraphs(spark.createDataFrame([(1, 1, "\\q9 x")], "id int, line_no int, line string"), "id").collect()


def test_names_with_a_separator_are_errors():
    with pytest.raises(ValueError):
        pages.ascii_name("a/b.txt")
    assert pages.ascii_name("Ёж и йод.DOC") == "iozh_i_iod.doc"


def test_ingest_takes_rows_once(spark, tmp_path):
    schema = "id int, ts timestamp"
    at = [f"file://{tmp_path}/{n}" for n in ("in", "table", "log")]
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("cast(id as int) as id", "timestamp '2020-01-01' + make_interval(id * 9) as ts")
    rows(0, 10).union(rows(0, 5)).write.parquet(at[0])
    assert ingest.ingest(spark, at[0], at[1], at[2], schema, ("id",)).count() == 10
    assert ingest.ingest(spark, at[0], at[1], at[2], schema, ("id",)).count() == 10
    rows(5, 20).write.mode("append").parquet(at[0])
    again = ingest.ingest(spark, at[0], at[1], at[2], schema, ("id",))
    assert sorted(r.id for r in again.collect()) == list(range(20))


def test_repairs_take_nulls_and_unknown_names(spark):
    rows = spark.createDataFrame([(None, "double-utf8"), ("x", None), ("þ", "finnish-lawtexts-in-pdf"), ("y", "none such")], "t string, g string")
    assert [r[0] for r in rows.select(encodings.repaired(F.col("t"), F.col("g"))).collect()] == [None, "x", "č", "y"]


def test_catalogue_of_nothing(spark):
    none = spark.createDataFrame([], "id int, path string, status string, text string")
    assert catalogue.repeated_members(none, "id", "text").count() == 0
    assert none.select(reader.reader_of(F.col("path"), F.col("status"))).count() == 0
    assert catalogue.wanted_languages(spark.createDataFrame([("en",)], "lang string"), []).collect()[0].known


def test_a_date_shorter_than_the_prefix(spark):
    spans = spark.createDataFrame([("2001", "2001", 3), ("20010101", "20010101", 4), ("", "", 5)], "datefrom string, dateto string, tokens int")
    got = {r.dateto: r.tokens for r in relations.tokens_per_year(spans).collect()}
    assert (got["2001"], got["20010101"], got[""]) == (7, 4, 12)


def test_margins_of_printed_pages(spark):
    """Own page before all pages before parity; edges are outside; inner margins leave out the middle."""
    margins = {"left_margin": {"all": 10.0, "2": 50.0}, "top_margin": {"odd": 10.0}, "inner_left_margin": {"4": 40.0}, "inner_right_margin": {"4": 40.0}}
    pieces = [(1, 10, 50), (1, 11, 50), (1, 11, 10), (2, 50, 1), (2, 51, 1), (2, 51, 0), (4, 50, 50), (4, 40, 50), (4, 60, 50), (4, 70, 50)]
    rows = spark.createDataFrame([(*p, 100, 100, margins) for p in pieces], "page int, left int, top int, width int, height int, margins map<string,map<string,double>>")
    assert [tuple(r)[:3] for r in printed.inside(rows).orderBy("page", "left", "top").collect()] == [(1, 11, 50), (2, 51, 1), (4, 40, 50), (4, 60, 50), (4, 70, 50)]
    assert printed.inside(rows.withColumn("margins", F.create_map().cast("map<string,map<string,double>>"))).count() == 9


def test_long_chains_of_replacements(spark):
    """More pairs than any number that a chain was once bounded by; what one makes, a later one sees, and an earlier one doesn't."""
    import random

    made = spark.range(120_000).select(F.col("id").alias("place"), F.format_string("word%06d", "id").alias("wrong"), F.format_string("w%06d", F.col("id") + 1).alias("right"))
    more = spark.createDataFrame([(120_000, "w000008", "č"), (120_001, "čč", "w000008"), (120_002, "w000008", None), (120_003, "", "x"), (5, None, "x")], "place bigint, wrong string, right string")
    docs = spark.createDataFrame([(0, "word000007word000007 word119999"), (1, None), (2, "w000008 word00000"), (3, "")], "id int, text string")
    got = {r["id"]: r["t"] for r in docs.select("id", X.replaced_by_table(F.col("text"), made.union(more)).alias("t")).collect()}
    assert got == {0: " w120000", 1: None, 2: "č word00000", 3: ""}
    r = random.Random(1)
    for _ in range(300):
        some = lambda least, most: "".join(r.choice("abč") for _ in range(r.randint(least, most)))
        chain, text = [(some(1, 4), some(0, 3)) for _ in range(r.randint(0, 8))], some(0, 25)
        want = text
        for wrong, right in chain:
            want = want.replace(wrong, right)
        table = X.pa.table({"wrong": X.pa.array([w for w, _ in chain], "string"), "right": X.pa.array([x for _, x in chain], "string")})
        assert X.Chain(table).applied(text) == want
