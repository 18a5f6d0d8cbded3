"""The Merkle manifest against a plain one, at several block sizes, and its defined odd cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import merkle_manifest, queries


def plain_h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return plain_h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """(siblings of every node as (on the left, digest), root)"""
    at, siblings = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for x, k in enumerate(at):
            if k ^ 1 < len(nodes):
                siblings[x].append((bool(k & 1), nodes[k ^ 1]))
            else:
                siblings[x].append((None, ""))
        nodes = [plain_h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at = [k // 2 for k in at]
    return siblings, nodes[0]


def plain_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    own = {v: sorted((r for r in rows if r[2] == v), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for v in langs}
    trees = {v: plain_tree([plain_leaf(r) for r in own[v]]) for v in langs}
    above, root = plain_tree([trees[v][1] for v in langs])
    out = []
    for v, up in zip(langs, above, strict=True):
        for r, low in zip(own[v], trees[v][0], strict=True):
            path = low + up
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = plain_leaf((*r[:3], r[3] + 1, r[4]) if tampered else r)
            for left, s in path:
                h = plain_h(s, h) if left else plain_h(h, s)
            out.append((r[0], plain_leaf(r), trees[v][1], root, plain_h(*(s for _, s in path)), h, h == root))
    return sorted(out, key=repr)


def rows_of(n):
    langs = ["en", "de", None, "", "é", "zz"] + [f"x{k}" for k in range(20)]
    rows = [(k, f"s{k % 3}" if k % 5 else None, langs[k % 3 if k % 4 else k % len(langs)], k * 3 if k % 6 else None, None if k % 11 == 0 else "ü" * (k % 7)) for k in range(n)]
    return [*rows, (3, "a", "en", 1, "again"), (3, "a", "en", 1, "again"), (None, "a", "en", 1, ""), (None, None, None, None, None), (-5, "-", "-", 0, "1:-"), (7**10, "s", "de", 2, "long " * 200_000)]


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "more", b"x") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, path string, node binary")
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    found = merkle_manifest.manifest(docs, changed={"n_chars": F.col("n_chars") + 1}, where=tampered).collect()
    return sorted(((r["doc_id"], *(bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "proof", "folded")), r["verified"]) for r in found), key=repr)


@pytest.mark.parametrize(("levels", "top"), [(10, 4096), (2, 8), (1, 2), (3, 1)])
def test_equals_a_plain_tree_at_every_size(spark, monkeypatch, levels, top):
    """Few top nodes: several reductions, and more languages than the driver may hold."""
    monkeypatch.setattr(merkle_manifest, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "TOP_NODES", top)
    rows = rows_of(150)
    found = manifest(spark, rows)
    assert found == plain_manifest(rows)
    assert any(not r[-1] for r in found) and any(r[-1] for r in found)


def test_one_row_and_no_row(spark):
    assert manifest(spark, [(1, None, "en", 4, "a")]) == plain_manifest([(1, None, "en", 4, "a")])
    assert manifest(spark, []) == []


def test_a_fold_needs_the_same_row(spark):
    nodes = [hashlib.sha256(bytes([k])).digest() for k in range(11)]
    paths, left = merkle_manifest.grown(nodes)
    assert all(merkle_manifest.folded(n, p) == left[0] for n, p in zip(nodes, paths, strict=True))
    assert merkle_manifest.folded(nodes[1], paths[0]) != left[0]


def test_query_has_the_columns_of_its_contract(spark, sf_dir):
    found = queries.op12_merkle_manifest(spark, sf_dir)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and len({r["root"] for r in rows}) == 1
    assert all(r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) for r in rows)
