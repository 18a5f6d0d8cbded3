"""The source divergence audit against a plain one, in small shards and teams, and its defined odd cases."""

import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import queries, source_divergence

SCALE = 10**9


def plain_audit(rows, top=200):
    """Sorted (lang, source, part, item, value, rank) of (text, lang, source)."""
    docs = [(re.findall("[a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or "")), la or "", s or "") for t, la, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        held = Counter(t for ws, _, _ in own for t in set(ws))
        kept = sorted((t for t, n in held.items() if n >= 3), key=lambda t: t.encode())
        sources = sorted({s for _, _, s in own})
        count = {s: Counter(t for ws, _, x in own if x == s for t in ws if held[t] >= 3) for s in sources}
        whole = sum(count.values(), Counter())

        def p(c, t):
            return 1 + SCALE * (c[t] + 1) // (sum(c.values()) + len(kept))

        def f(a, b):
            return (a - b) * (a - b) // b

        for s in sources:
            pairs = [(-sum(f(p(count[s], t), p(count[o], t)) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p(count[s], t), p(whole, t)), t.encode(), t) for t in kept if count[s][t] and p(count[s], t) > p(whole, t)]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", o, -v, k) for k, (v, _, o) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def texts(n, sources, seed):
    r = np.random.default_rng(seed)
    vocab = ["".join(chr(97 + int(c)) for c in r.integers(0, 26, r.integers(1, 5))) for _ in range(120)] + ["Äpfel", "été", "été", "日本", "\U00010400x"]
    return [(" ".join(vocab[min(int(x), len(vocab) - 1)] for x in r.zipf(1.3, r.integers(1, 60))), "en" if k % 3 else "de", f"s{int(r.integers(0, sources))}" if k % 4 else "s0") for k in range(n)]


ODD = [(None, "en", "s1"), ("", "en", "only empty"), ("12 !! 34", "xx", "a"), ("once", "xx", "b"), ("A a a", None, None), ("a B", None, None), ("a b", None, "z"), ("a", "", "y"), ("alone alone", "yy", "one"), ("Word " * 50_000, "en", "s2")]


def audit(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], "text string, lang string, source string, number bigint, term string, vector binary")
    return sorted(tuple(r) for r in source_divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("shard", "team", "rounds"), [(1 << 14, 8, 8), (7, 2, 3), (50, 1, 2)])
def test_equals_a_plain_audit_in_any_shards_and_teams(spark, monkeypatch, shard, team, rounds):
    for name, value in (("SHARD", shard), ("TEAM", team), ("ROUNDS_A_JOB", rounds)):
        monkeypatch.setattr(source_divergence, name, value)
    rows = texts(160, 7, 3) + ODD
    assert audit(spark, rows) == plain_audit(rows)


def test_without_rows(spark):
    assert audit(spark, []) == []


@pytest.mark.parametrize("teams", [2, 3, 4, 5, 8, 9])
def test_every_two_teams_meet_once(spark, teams):
    """All pairs of teams over the rounds of the circle method."""
    from pyspark.sql import functions as F

    rounds = teams + teams % 2 - 1
    met = []
    for turn in range(rounds):
        seats = spark.range(teams).withColumn("met", source_divergence.partner(F.col("id"), turn, F.lit(rounds).cast("bigint")))
        met += [tuple(r) for r in seats.where(f"met < id and id < {teams}").select("met", "id").collect()]
    assert sorted(met) == [(a, b) for a in range(teams) for b in range(a + 1, teams)]


def test_likelihood_is_exact_for_large_counts():
    n = np.array([0, 1, 10**14, 5 * 10**14], np.int64)
    total, terms = int(n.sum()), 4
    assert source_divergence.likelihood(n, total, terms).tolist() == [1 + SCALE * (int(x) + 1) // (total + terms) for x in n]
    p = source_divergence.likelihood(n, total, terms)
    assert source_divergence.divergence(p, p[::-1]).tolist() == [int(a - b) ** 2 // int(b) for a, b in zip(p, p[::-1], strict=True)]


def test_vectors_keep_their_counts():
    place, n = np.array([0, 3, 4, 99]), np.array([1, 2**40, 3, 4])
    assert source_divergence.unpack(source_divergence.pack(place, n), 100)[place].tolist() == n.tolist()
    assert source_divergence.unpack(None, 5).tolist() == [0] * 5


def test_query_ranks_pairs_and_terms(spark, sf_dir):
    found = queries.op13_source_divergence(spark, sf_dir).toPandas()
    assert sorted(found.columns) == ["item", "lang", "part", "rank", "source", "value"]
    for (_, _, part), g in found.groupby(["lang", "source", "part"]):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and g["value"].is_monotonic_decreasing
        assert part == "pair" or len(g) <= 200
