"""Near copies by wide SimHash fingerprints: kernels against plain forms, the stage against all pairs."""

import random

import numpy as np
import pytest

from corpusmill.llm import _shared, _words, simhash_popcount


def edited(seed, n, copies, share=0.2):
    """A text of n words and copies with words replaced, so that similarities lie on both sides of 0.8; share: of shingles that change at most."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(n)]
    texts = [" ".join(base)]
    for _ in range(copies):
        words = list(base)
        for at in r.sample(range(n), r.randint(1, max(1, int(n * share / 5)))):
            words[at] = f"new{r.random()}"
        texts.append(" ".join(words))
    return texts


def first_of_each(texts):
    """For each text the smallest number reachable over five-word similarities of 0.8."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    low = list(range(len(texts)))
    like = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while any(low[a] != low[b] for a, b in like):
        for a, b in like:
            low[a] = low[b] = min(low[a], low[b])
    return low


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_wide_fingerprints_are_majorities():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 254, 255, 256, 511, 3, 70_000, 40)]
    got = simhash_popcount.wide_fingerprints(sets, 3)
    for s, fp in zip(sets, got, strict=True):
        for k, word in enumerate(fp):
            h = _words.mix(s + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            assert np.packbits(2 * bits > len(s)).view(np.uint64)[0] == word


def test_bands_bring_texts_of_the_similarity_together():
    r = np.random.default_rng(3)
    bits, bands = simhash_popcount.bands_of(1000)
    a = [r.integers(0, 1 << 63, 300, dtype=np.uint64) for _ in range(1000)]
    b = [np.append(x[:267], r.integers(0, 1 << 63, 33, dtype=np.uint64)) for x in a]  # 267 of 333: 0.802
    fa, fb = (simhash_popcount.wide_fingerprints(x, simhash_popcount.CHECK_WORDS + -(-bits * bands // 64)) for x in (a, b))
    met = (simhash_popcount.cells(fa, bits, bands) == simhash_popcount.cells(fb, bits, bands)).any(1)
    distance = np.bitwise_count(fa ^ fb)[:, : simhash_popcount.CHECK_WORDS].sum(1)
    assert (met & (distance <= simhash_popcount.CHECK_DISTANCE)).mean() >= 0.998
    other = np.bitwise_count(fa ^ np.roll(fb, 1, axis=0))[:, : simhash_popcount.CHECK_WORDS].sum(1)
    assert (other > simhash_popcount.CHECK_DISTANCE).all()


def test_cell_stars_equal_all_pairs():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, (20, 2), dtype=np.uint64)
    check = base[r.integers(0, 20, 400)]
    for _ in range(25):  # distances on both sides of the bound, and chains
        check[np.arange(400), r.integers(0, 2, 400)] ^= np.uint64(1) << r.integers(0, 64, 400, dtype=np.uint64)
    cell, pid = np.sort(r.integers(0, 6, 400)), r.permutation(400).astype(np.int64)
    low = pid.copy()
    near = (np.bitwise_count(check[:, None] ^ check[None]).sum(2, dtype=np.int64) <= simhash_popcount.CHECK_DISTANCE) & (cell[:, None] == cell)
    while (new := np.where(near, low, 400).min(1)).tolist() != low.tolist():
        low = new
    u, v, n = simhash_popcount.cell_stars(cell, pid, check)
    size = {x: int((low == x).sum()) for x in set(low.tolist())}
    want = sorted((x, p, size[x]) for x, p in zip(low.tolist(), pid.tolist(), strict=True) if size[x] > 1)
    assert sorted(zip(u.tolist(), v.tolist(), n.tolist(), strict=True)) == want
    assert 1 < len(size) < 400


def test_the_near_dedup_stage_goes_by_simhash(spark, sf_dir, monkeypatch):
    """What the stage verifies is what fingerprints name: without their candidates it finds no edited copy."""
    import corpus_pipeline

    texts = edited(5, 120, 6, 0.1) + edited(6, 90, 0)
    kept = lambda: sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs_of(spark, texts), sf_dir).collect())
    assert kept() == sorted(set(first_of_each(texts))) == [0, 7]
    named = simhash_popcount.candidates
    monkeypatch.setattr(simhash_popcount, "candidates", lambda *a: named(*a).where("false"))
    assert kept() == list(range(8))


@pytest.mark.parametrize("crowd", [4096, 3])
def test_near_copies_equal_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash_popcount, "CROWD", crowd)
    texts = [None, "", "one two", "One  two", "a b c d e", "a b c d f"]
    for k in range(12):
        texts += edited(20 + k, 40 + 40 * k, 12)
    got = {r["doc_id"]: r["component_id"] for r in simhash_popcount.near_copies(docs_of(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == first_of_each(texts)


def test_no_link_is_lost_that_fingerprints_miss(spark, monkeypatch):
    """With one band hardly a pair shares a cell; still all links of the similarity are found, also of the shortest texts that can have it."""
    monkeypatch.setattr(simhash_popcount, "bands_of", lambda n: (14, 1))
    texts = [None, "", "a b c d e f g h", "a b c d e f g h i", "z b c d e f g h i"]
    for k in range(8):
        texts += edited(60 + k, 40 + 40 * k, 8)
    got = {r["doc_id"]: r["component_id"] for r in simhash_popcount.near_copies(docs_of(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == first_of_each(texts)


def test_near_copies_of_odd_rows(spark):
    rows = [(None, "x y z"), (3, "x y z"), (3, "x y z"), (3, "other words"), (1, None), (2, ""), (4, " \n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in simhash_popcount.near_copies(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3), (3, 3), (4, 1)]
    assert simhash_popcount.near_copies(docs.where("false")).count() == 0
    with _shared.Scratch() as tmp:
        none = tmp(spark.createDataFrame([], "pid bigint, " + ", ".join(f"f{k} bigint" for k in range(22))))
        assert simhash_popcount.candidates(none, 14, 88, tmp).count() == 0
