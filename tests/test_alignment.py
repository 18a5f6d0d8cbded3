"""Sentence alignment in a band against the whole table, with and without anchors."""

import math
import random
import time

import numpy as np
import pytest

from corpusmill.operators import alignment as A


def whole_table(a, b, anchors):
    """Least cost of all ways to pair the sentences, cell by cell."""
    best = np.full((len(a) + 1, len(b) + 1), np.inf)
    best[0, 0] = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            for (m, n), p in A.BEADS.items():
                if i >= m and j >= n and best[i - m, j - n] < np.inf:
                    best[i, j] = min(best[i, j], best[i - m, j - n] + bead_cost(a[i - m : i], b[j - n : j], p, anchors))
    return best[len(a), len(b)]


def bead_cost(x, y, p, anchors):
    left, right = set(" ".join(x).lower().split()), set(" ".join(y).lower().split())
    bonus = sum(1 for w in left if anchors.get(w, set()) & right) if x and y else 0
    return -math.log(p) + float(A._cost(np.array([sum(map(len, x))]), np.array([sum(map(len, y))]))[0]) - bonus


def cost_of(beads, a, b, anchors):
    return sum(bead_cost([a[i] for i in p], [b[j] for j in q], A.BEADS[len(p), len(q)], anchors) for p, q in beads)


def sides(r, n):
    words = ["".join(r.choices("abcdef", k=r.randint(1, 6))) for _ in range(40)]
    a = [" ".join(r.choices(words, k=r.randint(1, 12))) for _ in range(n)]
    b = [s.upper() if r.random() < 0.8 else " ".join(r.choices(words, k=r.randint(1, 12))) for s in a if r.random() > 0.1]
    for _ in range(r.randint(0, 6)):
        b.insert(r.randint(0, len(b)), " ".join(r.choices(words, k=3)))
    return a, b, {w: {w, r.choice(words)} for w in words if r.random() < 0.5}


@pytest.mark.parametrize("seed", range(12))
def test_equals_the_whole_table(seed):
    r = random.Random(seed)
    a, b, anchors = sides(r, r.choice([0, 1, 2, 7, 25]))
    for table in ({}, anchors):
        beads = A.align_lists(a, b, table, width=r.choice([1, 2, 64]))
        assert [i for p, _ in beads for i in p] == list(range(len(a))) and [j for _, q in beads for j in q] == list(range(len(b)))
        assert cost_of(beads, a, b, table) == pytest.approx(whole_table(a, b, table))


def test_a_path_far_from_the_diagonal_widens_the_band():
    a = [f"sentence number {k} here" for k in range(40)]
    b = ["x"] * 90 + a
    beads = A.align_lists(a, b, {str(k): {str(k)} for k in range(40)}, width=4)
    assert sum(1 for p, q in beads if len(p) == len(q) == 1 and a[p[0]] == b[q[0]]) >= 38


def words(name):
    return " ".join(f"{name}{k}" for k in range(9))


def test_anchors_decide_between_equal_lengths():
    a, b = [words("a"), words("b")], [words("x"), words("y"), words("z")]
    table = {f"{w}{k}": {f"{o}{k}"} for w, o in (("a", "y"), ("b", "z")) for k in range(9)}
    of = {j: p for p, q in A.align_lists(a, b, table) for j in q}
    assert of[1] == [0] and of[2] == [1]
    assert {j: p for p, q in A.align_lists(a, b, {f"{w}{k}": {f"{o}{k}"} for w, o in (("a", "x"), ("b", "y")) for k in range(9)}) for j in q}[0] == [0]


def test_large_sides_stay_in_bounded_memory():
    r = random.Random(1)
    a, b, _ = sides(r, 4000)
    began = time.time()
    assert len(A.align_lists(a, b)) >= 3000 and time.time() - began < 60


def test_anchors_come_from_a_table(spark):
    rows = lambda texts: spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "id bigint, sentence_no int, sentence string")
    anchors = spark.createDataFrame([(f"{w.upper()}{k}", f"{o}{k}") for w, o in (("a", "y"), ("b", "z")) for k in range(9)], "w1 string, w2 string")
    got = A.aligned_sentences(rows([words("a"), words("b")]), rows([words("x"), words("y"), words("z")]), "id", anchors).collect()
    assert any(r["src_text"] == words("b") and r["tgt_text"] == words("z") for r in got)
