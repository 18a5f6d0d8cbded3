"""Merkle manifest of a dataset: a digest and a proof for every row, and one root for all.

Each row is a leaf. The leaves of one language, in order of their ids, are reduced by twos to a sub-root, the sub-roots, in order of their
languages, to the root. Every two consecutive nodes become the digest of both; a last node without a partner becomes the digest of itself.

Upper-tree variant: places within a language come from range partitions and their counts, so no task numbers a whole language. Blocks of
2**BLOCK_LEVELS consecutive nodes are then reduced in tasks of their own, which note each node's path within its block, and the blocks' roots
are the nodes of the next reduction, until at most TOP_NODES are left. (Are those mostly sub-roots, because languages are very many,
these are numbered and reduced in the same way.) The driver builds the small tree above and broadcasts each remaining node's suffix path; the
proofs of blocks below, and at last of rows, are finished on the executors, where each row also folds its own leaf up to the root.

A path holds, level by level, a flag (no sibling, one on the right, one on the left) and the sibling's digest.

Defined cases: a null field is `-`, which no value is written as; a null id or language comes first; rows that repeat an id are leaves of
their own, in the order of their digests; an empty table gives an empty result; very long texts are hashed whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import _shared
from corpusmill.operators.numbering import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
GROUP, ORDER = "lang", "doc_id"

#: Levels that a block reduces (it has 1,024 nodes at most), and nodes that the driver's tree begins with at most (a path and its keys: about 1 kB).
BLOCK_LEVELS, TOP_NODES = 10, 1 << 12

_SIZE = hashlib.sha256().digest_size
_NONE, _RIGHT, _LEFT = b"\0", b"\1", b"\2"


# ---- leaves


def field(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row's fields as bytes."""
    return F.unhex(F.sha2(F.encode(F.concat(*map(field, columns.values())), "UTF-8"), 256))


def leaves(rows: DataFrame, fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf and altered: the leaf of the row with `changed` columns, null unless `where` holds."""
    own = {c: F.col(c) for c in fields}
    altered = F.when(where, leaf(own | changed)) if changed else F.lit(None).cast("binary")
    return rows.select(F.col(ORDER), F.col(GROUP), leaf(own).alias("leaf"), altered.alias("altered"))


# ---- trees


def parent(nodes: list[bytes]) -> bytes:
    """The digest of some digests, as hexadecimal text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def grown(nodes: list[bytes], levels: int | None = None) -> tuple[list[bytes], list[bytes]]:
    """(paths, nodes left) after so many levels, or up to one node."""
    paths, at = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while (len(nodes) > 1) if levels is None else levels > 0:
        levels = levels if levels is None else levels - 1
        for k, below in enumerate(at):
            step = _NONE if k ^ 1 >= len(nodes) else (_LEFT if k & 1 else _RIGHT) + nodes[k ^ 1]
            for x in below:
                paths[x].append(step)
        at = [[x for below in at[k : k + 2] for x in below] for k in range(0, len(at), 2)]
        nodes = [parent(nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return [b"".join(p) for p in paths], nodes


def steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(flag, sibling) of every level."""
    at = 0
    while at < len(path):
        flag = path[at : at + 1]
        at += 1
        yield flag, path[at : at + _SIZE] if flag != _NONE else b""
        at += _SIZE if flag != _NONE else 0


def folded(node: bytes, path: bytes) -> bytes:
    """What a node becomes along its path."""
    for flag, sibling in steps(path):
        node = parent([sibling, node] if flag == _LEFT else [node, sibling])
    return node


def proof(path: bytes) -> bytes:
    """The digest of all siblings of a path."""
    return parent([sibling for flag, sibling in steps(path) if flag != _NONE])


# ---- blocks


def _mapped(rows: DataFrame, schema: str, make: Callable[[pa.RecordBatch], dict[str, list]], drop: tuple[str, ...] = ()) -> DataFrame:
    """The rows with further columns (`schema`), which `make` works out batch by batch."""
    names = [c for c in rows.columns if c not in drop]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = make(b)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(v, pa.bool_() if k == "verified" else pa.binary()) for k, v in made.items())], names=[*names, *made])

    return rows.mapInArrow(run, ", ".join([*fields, schema]))


def reduced(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, number, size, node and further columns) with their path in their block, the block's number (up) and its root (top).

    A tree of one block is reduced to its root, any other block by BLOCK_LEVELS. Null is a tree of its own.
    """
    names, width = nodes.columns, 1 << BLOCK_LEVELS
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    levels = BLOCK_LEVELS

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        several = table.column("size")[0].as_py() > width
        paths, left = grown(table.column("node").to_pylist(), levels if several else None)
        up = table.column("number")[0].as_py() >> levels
        more = [pa.array(paths, pa.binary()), pa.array([up] * len(paths), pa.int64()), pa.array(left * len(paths), pa.binary())]
        return pa.Table.from_arrays([*(table.column(c) for c in names), *more], names=[*names, "path", "up", "top"])

    return nodes.groupBy("tree", F.shiftright("number", levels)).applyInArrow(run, f"{fields}, path binary, up bigint, top binary")


def _crown(nodes: list) -> tuple[dict, bytes]:
    """({(tree, number): (suffix path, sub-root)}, root) of trees whose nodes are all here."""
    trees = defaultdict(list)
    for r in sorted(nodes, key=lambda r: r["number"]):
        trees[r["tree"]].append(r)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    own = {t: grown([bytes(r["node"]) for r in trees[t]]) for t in names}
    above, root = grown([own[t][1][0] for t in names])
    suffix = {(t, r["number"]): (path + up, own[t][1][0]) for t, up in zip(names, above, strict=True) for r, path in zip(trees[t], own[t][0], strict=True)}
    return suffix, root[0] if root else b""


def paths(nodes: DataFrame, tmp: _shared.Scratch) -> tuple[DataFrame, bytes]:
    """(nodes with their path to the root and their tree's sub-root, root). nodes: (tree, number, size, node and further columns)."""
    done = tmp(reduced(nodes))
    width = 1 << BLOCK_LEVELS
    size = F.ceil(F.col("size") / width).cast("bigint")
    left = tmp(done.where(F.col("number") % width == 0).select("tree", F.col("up").alias("number"), size.alias("size"), F.col("top").alias("node")))
    count = left.count()
    if count <= TOP_NODES:
        suffix, root = _crown(left.collect())
        shared = nodes.sparkSession.sparkContext.broadcast(suffix)

        def finish(b: pa.RecordBatch) -> dict[str, list]:
            rest = [shared.value[key] for key in zip(b.column("tree").to_pylist(), b.column("up").to_pylist(), strict=True)]
            return {"path": [p + more for p, (more, _) in zip(b.column("path").to_pylist(), rest, strict=True)], "subroot": [s for _, s in rest]}

        return _mapped(done, "path binary, subroot binary", finish, ("path", "size", "top")), root
    if left.where("size > 1").limit(1).count():
        upper, root = paths(left, tmp)
        rest = upper.select(F.col("tree").alias("t"), F.col("number").alias("n"), F.col("path").alias("rest"), "subroot")
    else:  # nothing but sub-roots: they are the leaves of one tree above
        langs = numbered(left.select(F.col("tree").alias("lang"), "node"), ["lang"], first=0, keep=tmp)
        upper, root = paths(langs.select(F.lit("").alias("tree"), "number", F.lit(count).cast("bigint").alias("size"), "node", "lang"), tmp)
        rest = upper.select(F.col("lang").alias("t"), F.lit(0).cast("bigint").alias("n"), F.col("path").alias("rest"), F.col("node").alias("subroot"))
    joined = done.drop("size", "top").join(rest, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")))
    return joined.withColumn("path", F.concat("path", "rest")).drop("t", "n", "rest"), root


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """doc_id, lang, number (place in its language), leaf, altered, path, subroot, root, proof, folded and verified of every row; digests are bytes.

    altered: the leaf of the row with `changed` columns where `where` holds, else null; folded: where the altered leaf, or else the leaf itself,
    leads to along the path; verified: whether that is the root.
    """
    with _shared.Scratch() as tmp:
        placed = numbered(tmp(leaves(rows, fields, changed, where)), [GROUP, ORDER, "leaf"], [GROUP], first=0, keep=tmp)
        nodes = placed.select(F.col(GROUP).alias("tree"), "number", F.col("number_of").alias("size"), F.col("leaf").alias("node"), ORDER, "altered")
        whole, root = paths(nodes, tmp)

        def fold(b: pa.RecordBatch) -> dict[str, list]:
            own, altered, path = (b.column(c).to_pylist() for c in ("node", "altered", "path"))
            ends = [folded(n if a is None else a, p) for n, a, p in zip(own, altered, path, strict=True)]
            return {"root": [root] * len(own), "proof": [proof(p) for p in path], "folded": ends, "verified": [e == root for e in ends]}

        done = _mapped(whole.drop("up"), "root binary, proof binary, folded binary, verified boolean", fold)
        return _shared.written(done.withColumnRenamed("tree", GROUP).withColumnRenamed("node", "leaf"))
