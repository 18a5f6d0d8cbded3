"""Approximate nearest neighbours by a forest of hash-prefix trees (LSH Forest, Bawa et al. 2005), for the largest inner product.

Every tree gives a vector a string of BITS random-hyperplane bits and keeps the strings as sorted arrays, dealt over the cluster by
(tree, first bits). A query descends in each array to its longest-prefix match; then all trees ascend in step: from the number of
strings that share each prefix length with it, summed over the trees, every query gets its own length, the longest at which the
forest holds at least `enough` strings. In a second pass each array scores what shares that many bits with the query, a stretch of
the sorted array, and keeps its best. Only strings travel in the first pass.

`enough` is measured, not guessed: for a bounded sample of queries the true neighbours are found by scoring all vectors, and it is the
least number at which the share of them that the forest meets reaches TARGET. Clustered vectors need few strings and so stop at long
prefixes; vectors without structure need many. The sample's shortest length, less one, is the last level: arrays are dealt by it.

For inner products, a data vector gets one more coordinate that brings all of them to one length (Neyshabur and Srebro 2015), and a
query gets zero there. A part of an array with more than BLOCK vectors is split into as many parts and its queries visit every part, so
no task holds an unbounded array and no candidate is dropped. Equal vectors are one class with its 21 smallest ids, which is all
that any answer can use. Queries left with fewer than k neighbours are answered by scoring all vectors, in blocks.
Scores are sums of products in double, in one order of summation wherever they are worked out.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as query or candidate,
nor do null ids and vectors of another length than the most frequent one; repeated rows of one id count once; ties go to
the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import _shared

TREES, BITS, BLOCK = 20, 32, 8192
#: Queries of the calibration sample, and the share of their neighbours that the forest must meet.
SAMPLE, TARGET = 64, 0.95


def usable(embeddings: DataFrame) -> DataFrame:
    """Distinct (vec_id, vec) that take part; vec as double."""
    vec = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = embeddings.where("vec_id is not null and embedding is not null").select("vec_id", vec.alias("vec"))
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0))
    d = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vec") == (d[0] if d else 0)).distinct()


def classes(rows: DataFrame, every: int, k: int) -> DataFrame:
    """One row for each distinct vector: cid (its smallest id), ids (its k + 1 smallest), asked (whether a query has it), packed (doubles)."""
    w = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).groupBy("vec").agg(F.min("vec_id").alias("cid"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(F.col("vec_id") % every == 0).select("vec").distinct().withColumn("asked", F.lit(True))
    found = few.join(asked, "vec", "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.asarray(v, np.float64).tobytes() for v in b.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("ids"), b.column("asked").fill_null(False), pa.array(packed, pa.binary())], names=["cid", "ids", "asked", "packed"])

    return found.mapInArrow(pack, "cid bigint, ids array<bigint>, asked boolean, packed binary")


def planes(dim: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim + 1, TREES * BITS))


def hashes(vectors: np.ndarray, radius: float | None, normals: np.ndarray) -> np.ndarray:
    """Strings of every vector in every tree, as integers of BITS bits. radius: largest norm, for data; None for queries."""
    norm2 = (vectors**2).sum(1)
    if radius is None:
        more = np.zeros(len(vectors))
    else:
        more = np.sqrt(np.maximum(radius**2 - norm2, 0))
    bits = (np.column_stack([vectors, more]) @ normals > 0).reshape(len(vectors), TREES, BITS)
    return (bits * (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).sum(2)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading bits that two strings share."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def _unpack(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def _calibration(shared: np.ndarray, met: np.ndarray, owner: np.ndarray, target: float) -> tuple[int, int]:
    """(enough, last level). shared: sample queries x prefix lengths, strings that share at least so many bits; met: longest prefix shared with each true neighbour of query `owner`."""
    enough = 1
    while True:
        level = np.where(shared >= enough, np.arange(shared.shape[1]), 0).max(1)
        if (met >= level[owner]).mean() >= target or not level.any():
            return enough, int(max(0, level.min() - 1))
        enough = int(np.ceil(enough * 1.25))


def calibrate(data: DataFrame, dim: int, radius: float, k: int, target: float = TARGET) -> tuple[int, int]:
    """How many strings are enough, and the last level, from a sample of queries and their true neighbours."""
    asked = data.where("asked").orderBy(F.xxhash64("cid"), "cid").select("cid", "packed").limit(SAMPLE).collect()
    if not asked:
        return 1, 0
    normals = planes(dim)
    qid = np.array([r[0] for r in asked])
    q = _unpack([r[1] for r in asked], dim)
    qh = hashes(q, None, normals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (q, length, score) of the best vectors, and (q, length, null, n) of how many strings share just so many bits."""
        best: list[tuple[int, int, float | None, int]] = []
        held = np.zeros((len(q), BITS + 1), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            v, cid = _unpack(b.column("packed").to_pylist(), dim), b.column("cid").to_numpy()
            score = q @ v.T
            score[qid[:, None] == cid[None, :]] = -np.inf
            h = hashes(v, radius, normals)
            top = np.argsort(-score, axis=1)[:, :k]
            for i in range(len(q)):
                common = common_prefix(qh[i][None, :], h)
                held[i] += np.bincount(common.ravel(), minlength=BITS + 1)
                met = common[top[i]].max(1)
                best += [x for x in zip([i] * len(met), met.tolist(), score[i, top[i]].tolist(), [1] * len(met), strict=True) if x[2] > -np.inf]
            best = [x for i in range(len(q)) for x in sorted((x for x in best if x[0] == i), key=lambda x: -x[2])[:k]]
        best += [(i, int(c), None, int(held[i, c])) for i in range(len(q)) for c in np.flatnonzero(held[i])]
        columns = [pa.array([x[j] for x in best], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["q", "length", "score", "n"])

    found = data.select("cid", "packed").mapInArrow(run, "q int, length int, score double, n bigint")
    w = Window.partitionBy("q").orderBy(F.desc("score"))
    with _shared.Scratch() as tmp:
        found = tmp(found)
        near = found.where("score is not null").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).select("q", "length").toPandas()
        counts = found.where("score is null").groupBy("q", "length").agg(F.sum("n").alias("n")).toPandas()
    if not len(near):
        return 1, 0
    held = np.zeros((len(q), BITS + 1), np.int64)
    held[counts["q"], counts["length"]] = counts["n"]
    return _calibration(held[:, ::-1].cumsum(1)[:, ::-1], near["length"].to_numpy(), near["q"].to_numpy(), target)


def stretch(h: np.ndarray, asked: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last place in the sorted array h of the strings that share `level` leading bits with each asked one."""
    low = asked >> (BITS - level) << (BITS - level)
    return np.searchsorted(h, low, "left"), np.searchsorted(h, low + (np.int64(1) << (BITS - level)), "left")


def _shared_lengths(part: pd.DataFrame, last: int) -> pd.DataFrame:
    """(q, level, n): strings of one array that share at least `level` bits with each query, for every level from the longest match down."""
    ask = part["ask"].to_numpy()
    h = np.sort(part["h"].to_numpy()[~ask])
    qh, q = part["h"].to_numpy()[ask], part["cid"].to_numpy()[ask]
    out = []
    for level in range(last, BITS + 1):
        lo, hi = stretch(h, qh, np.full(len(qh), level))
        some = hi > lo
        out.append(pd.DataFrame({"q": q[some], "level": np.int32(level), "n": (hi - lo)[some]}))
    return pd.concat(out)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in the same order whatever stands beside it."""
    return np.add.reduce(np.ascontiguousarray(a * b), axis=1)


def _nearest(part: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    """The best k + 1 of one sorted array for each of its queries, among the strings that share its level's bits; ties at the end stay."""
    ask = part["ask"].to_numpy()
    data, asks = part[~ask].sort_values("h", kind="stable"), part[ask].sort_values("h", kind="stable")
    h, cid, v = data["h"].to_numpy(), data["cid"].to_numpy(), _unpack(data["packed"], dim)
    q, qcid = _unpack(asks["packed"], dim), asks["cid"].to_numpy()
    lo, hi = stretch(h, asks["h"].to_numpy(), asks["level"].to_numpy().astype(np.int64))
    out = [pd.DataFrame({"q": np.empty(0, np.int64), "cid": np.empty(0, np.int64), "score": np.empty(0)})]
    for at in range(0, len(q), 256):
        a, b = lo[at : at + 256], hi[at : at + 256]
        first, end = int(a.min()), int(b.max())
        if first >= end:
            continue
        score = q[at : at + 256] @ v[first:end].T
        place = np.arange(first, end)
        score[(place < a[:, None]) | (place >= b[:, None])] = -np.inf
        m = min(k + 1, end - first)
        kth = np.partition(score, end - first - m, axis=1)[:, end - first - m]
        slack = 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(kth), kth, 0)))
        row, col = np.nonzero((score >= (np.where(np.isfinite(kth), kth, -1e300) - slack)[:, None]) & np.isfinite(score))
        out.append(pd.DataFrame({"q": qcid[at + row], "cid": cid[first + col], "score": exact_scores(q[at + row], v[first + col])}))
    return pd.concat(out)


_FILED = "tree int, h bigint, cid bigint, ask boolean"


def filed(data: DataFrame, dim: int, radius: float, vectors: bool) -> DataFrame:
    """Strings of every class in every tree, once as data and, where asked, once as a query; with or without the vectors."""
    normals = planes(dim)
    names = ["tree", "h", "cid", "ask", *["packed"] * vectors]

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                s = b.slice(at, 2048)
                v = _unpack(s.column("packed").to_pylist(), dim)
                asked = np.flatnonzero(s.column("asked").to_numpy(zero_copy_only=False))
                for rows, h, ask in ((np.arange(len(v)), hashes(v, radius, normals), False), (asked, hashes(v[asked], None, normals), True)):
                    take = pa.array(np.repeat(rows, TREES))
                    tree = np.tile(np.arange(TREES, dtype=np.int32), len(rows))
                    columns = [pa.array(tree), pa.array(h.ravel()), s.column("cid").take(take), pa.array(np.full(len(tree), ask))]
                    yield pa.RecordBatch.from_arrays([*columns, *([s.column("packed").take(take)] if vectors else [])], names=names)

    return data.select("cid", "asked", "packed").mapInArrow(strings, _FILED + ", packed binary" * vectors)


def _dealt(rows: DataFrame, sizes: DataFrame, last: int) -> DataFrame:
    """Rows with the part of their array: data in one part each, queries in all."""
    every = F.when(F.col("ask"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")))
    return rows.withColumn("prefix", F.shiftright("h", BITS - last)).join(sizes, ["tree", "prefix"]).withColumn("part", F.explode(every))


def candidates(data: DataFrame, dim: int, radius: float, enough: int, last: int, k: int, tmp: _shared.Scratch) -> DataFrame:
    """(q, cid, score): for each asked class, the best classes among the strings that its own prefix length selects in the trees."""
    names = filed(data, dim, radius, vectors=False)
    sizes = tmp(names.where("not ask").groupBy("tree", F.shiftright("h", BITS - last).alias("prefix")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    lengths = _dealt(names, sizes, last).groupBy("tree", "prefix", "part").applyInPandas(lambda p: _shared_lengths(p, last), "q bigint, level int, n bigint")
    summed = lengths.groupBy("q", "level").agg(F.sum("n").alias("n"))
    level = tmp(summed.groupBy("q").agg(F.coalesce(F.max(F.when(F.col("n") >= enough, F.col("level"))), F.lit(last)).alias("level")))
    whole = filed(data, dim, radius, vectors=True)
    own = whole.where("ask").join(level.select(F.col("q").alias("cid"), "level"), "cid").select(*whole.columns, "level")
    both = own.unionByName(whole.where("not ask").withColumn("level", F.lit(0)))
    met = _dealt(both, sizes, last).groupBy("tree", "prefix", "part").applyInPandas(lambda p: _nearest(p, dim, k), "q bigint, cid bigint, score double")
    return _best(met.distinct(), k)


def _best(met: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    return met.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).drop("n")


def exhaustive(data: DataFrame, asked: DataFrame, dim: int, k: int, n: int) -> DataFrame:
    """Like candidates(), for the classes in `asked` (q), by scoring all n vectors in blocks of BLOCK."""
    parts = -(-n // BLOCK)
    part = F.pmod(F.xxhash64("cid"), F.lit(parts)).cast("int")
    plain = [F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("level"), "packed"]
    q = data.join(asked.withColumnRenamed("q", "cid"), "cid", "left_semi").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "cid", F.lit(True).alias("ask"), *plain)
    both = q.unionByName(data.select(part.alias("part"), "cid", F.lit(False).alias("ask"), *plain))
    return _best(both.groupBy("part").applyInPandas(lambda p: _nearest(p, dim, k), "q bigint, cid bigint, score double"), k)


def search(embeddings: DataFrame, every: int = 20, k: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id `every` divides, among all other rows."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    with _shared.Scratch() as tmp:
        found = _search(rows, every, k, target, tmp)
        return _shared.written(found) if found is not None else spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")


def _search(rows: DataFrame, every: int, k: int, target: float, tmp: _shared.Scratch) -> DataFrame | None:
    data = tmp(classes(rows, every, k))
    facts = data.agg(F.max(F.octet_length("packed")), F.count("*"))
    width, n = facts.first()
    if not n:
        return None
    dim = width // 8

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array((_unpack(b.column(0).to_pylist(), dim) ** 2).sum(1))], names=["n2"])

    radius = float(np.sqrt(data.select("packed").mapInArrow(norms, "n2 double").agg(F.max("n2")).first()[0]))
    enough, last = calibrate(data, dim, radius, k, target)
    met = tmp(candidates(data, dim, radius, enough, last, k, tmp))
    # each class is its own nearest or not, and holds other ids or not: fewer than k + 1 classes may still be enough, but are never too few here
    short = data.where("asked").select(F.col("cid").alias("q")).join(met.groupBy("q").agg(F.count("*").alias("m")), "q", "left").where(F.coalesce("m", F.lit(0)) < min(k + 1, n)).select("q")
    short = tmp(short)
    if short.limit(1).count():
        met = _best(met.union(exhaustive(data, short, dim, k, n)).distinct(), k)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    named = met.join(data.select("cid", "ids"), "cid").select("q", "score", F.explode("ids").alias("vec_id"))
    best = named.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))
    class_of = rows.where(F.col("vec_id") % every == 0).join(rows.groupBy("vec").agg(F.min("vec_id").alias("q")), "vec").select(F.col("vec_id").alias("query_id"), "q")
    own = class_of.join(lists, "q").select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))
