"""SimHash near-duplicates by a grid range-join over per-segment bit counts.

A fingerprint's 64 bits fall into 16 segments of four; its embedding is the vector of their bit counts. Two fingerprints
that differ in d bits have embeddings at Manhattan distance d at most, so a range-join of the embeddings at distance 2 loses no
link at Hamming distance 2. The grid is the integer lattice: each distinct fingerprint is filed in its own cell and the 32
cells next to it, and two points at distance 2 or less always share one of those cells, because a lattice path between them has
a middle point. Members of a cell are then verified on the fingerprints themselves.

A cell with more than CELL_PAIRS members (a dense group of near copies) isn't paired: each of its fingerprints is filed
under itself and its 64 one-bit variants. Two fingerprints within two bits share such a code, any two that share one are
within two bits, and a code has at most 65 members, so pointing each at the code's smallest member is exact and linear.

near_copies() is the same method at a wider radius, for edited copies: texts whose five-word shingles have a Jaccard similarity of
SIMILARITY differ in about 15 % of their fingerprint's bits, too many for 64 bits and the grid. So a text has a fingerprint of more bits,
each by the same majority over its shingles: CHECK_WORDS words whose Hamming distance decides which pairs are candidates, and
bands of a few bits, independent of them, that choose which fingerprints are compared (the block-permuted tables of SimHash).
Exact similarity then decides, by paragraph_minhash's verification: all pairs of a component of candidates, whatever its size. Two
texts at similarity 0.8 share a band with probability 1 - MISS and are near enough with probability 0.99999; at 0.85 only
about one pair in a million is missed. Of ten shingles or fewer a bit differs more often (4 of 5: 0.1875; found with probability 0.99).
What fingerprints miss is named by the exact set join of jaccard_trie, so no link of the similarity is left out. A cell of more than CROWD
texts isn't compared in a task: all its members are candidates, and exact similarity sorts them out.

Links are held between distinct fingerprints, represented by their smallest document; copies never become pairs.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; repeated ids are rows of their own with
the same component; an empty table gives an empty result; null ids keep their row, but stand for no component.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import _shared, _words, jaccard_trie, paragraph_minhash
from corpusmill.llm.paragraph_minhash import SIMILARITY

SHINGLE, SEED, MAX_DISTANCE = 3, 42, 2
CELL_PAIRS = 48

#: Near copies: words a shingle, bits of a band (more from 16 million texts on), 64-bit words that are compared and the distance allowed in them.
TEXT_SHINGLE, BAND_BITS, CHECK_WORDS, CHECK_DISTANCE = 5, 14, 2, 38
#: Chance that two texts of the similarity share no band; largest cell whose fingerprints are compared; rows of cells compared at once.
MISS, CROWD, ROWS_AT_ONCE = 1e-4, 4096, 1 << 17


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n) + 1
    end = np.cumsum(sizes)
    start = end - sizes
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(start[: n - shingle + 1].tolist(), (end[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64, n - shingle + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """`keep` and fp (the 64 bits as a long) of every row."""
    schema = T.StructType([*documents.select(*keep).schema.fields, T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.chunks(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(fp)], names=schema.names)

    return documents.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def embedding(fp: Column) -> Column:
    """Bit counts of the 16 segments, plus one each, as the hexadecimal digits of a long."""

    def half(x: Column) -> Column:
        pairs = x.bitwiseAND(_long(0x55555555)) + F.shiftrightunsigned(x, 1).bitwiseAND(_long(0x55555555))
        return pairs.bitwiseAND(_long(0x33333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(_long(0x33333333)) + _long(0x11111111)

    return F.shiftleft(half(F.shiftrightunsigned(fp, 32)), 32).bitwiseOR(half(fp.bitwiseAND(_long(0xFFFFFFFF))))


def links(points: DataFrame) -> DataFrame:
    """(u, v): edges between nodes whose fingerprints differ in MAX_DISTANCE bits or fewer, enough to connect all such pairs.

    points: (node, fp), each fp once.
    """
    at = embedding(F.col("fp"))
    steps = [F.lit(0).cast("long")] + [_long(s << 4 * k) if s > 0 else -_long(1 << 4 * k) for k in range(16) for s in (1, -1)]
    filed = points.withColumn("at", at).select("node", "fp", F.explode(F.array(*(F.col("at") + s for s in steps))).alias("cell"))
    sized = filed.withColumn("size", F.expr("count(1) over (partition by cell)")).where("size > 1")
    small = sized.where(f"size <= {CELL_PAIRS}").groupBy("cell").agg(F.collect_list(F.struct("fp", "node")).alias("m"))
    pairs = small.select(
        F.explode(
            F.expr(f"flatten(transform(m, (a, i) -> transform(filter(slice(m, i + 2, {CELL_PAIRS}), b -> bit_count(a.fp ^ b.fp) <= {MAX_DISTANCE}), b -> struct(a.node as u, b.node as v))))")
        ).alias("e")
    ).select("e.*")
    return pairs.union(dense_links(sized.where(f"size > {CELL_PAIRS}").select("node", "fp").distinct())).distinct()


def dense_links(points: DataFrame) -> DataFrame:
    """Exact links at distance 2 or less through shared one-bit variants; no more than 65 rows for a point."""
    codes = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(_long(1 << k)) for k in range(64)))
    by_code = points.select("node", F.explode(codes).alias("code"))
    members = by_code.groupBy("code").agg(F.min("node").alias("u"), F.collect_list("node").alias("m")).where("size(m) > 1")
    return members.select("u", F.explode("m").alias("v")).where("u <> v").distinct()


def near_duplicates(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, fp and component_id (the smallest doc_id reachable over links) of every row."""
    rows = _shared.written(fingerprints(documents, keep))
    with _shared.Scratch() as tmp:
        points = tmp(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
        found = _shared.components(links(points), tmp)
        # one row for each fingerprint: many copies share a key here, and adaptive execution splits them
        component = _shared.written(points.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    return rows.join(component, "fp", "left").select(*keep, "fp", "component_id")


# ---- edited copies


def bands_of(n: int) -> tuple[int, int]:
    """(bits of a band, bands) for n texts: cells keep about a thousand texts at most, bands so many that MISS holds."""
    bits = max(BAND_BITS, n.bit_length() - 10)
    agree = (1 - math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def text_shingles(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct five-word shingles of each text (words between white space; a text of five words or fewer is one), and a hash of each set."""
    w = _words.split_words(texts, _words.NONBLANK)
    grams, at = _words.windows(w, TEXT_SHINGLE)
    edge = np.searchsorted(at, w.first)
    own = []
    for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        few = w.hash[w.first[k] : w.first[k + 1]]
        own.append(np.unique(grams[a:b]) if b > a else _words.mix(np.array([zlib.crc32(few.tobytes()) + (int(few.sum()) & (1 << 63) - 1)], np.uint64)))
    pid = np.array([_words.mix(_words.mix(s).sum(keepdims=True) + np.uint64(len(s)))[0] for s in own], np.uint64)
    return own, pid.view(np.int64)


def wide_fingerprints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """Fingerprints of `words` times 64 bits: a bit is 1 if set in over half of a set's hashes; each word has hashes of its own. No set is empty."""
    n = np.array([len(s) for s in sets])
    # counts of up to 255 hashes fit into bytes, eight of which are added as one number
    parts = -(-n // 255)
    owner = np.repeat(np.arange(len(n)), parts)
    first = np.cumsum(n) - n
    start = np.append(first[owner] + 255 * (np.arange(len(owner)) - (np.cumsum(parts) - parts)[owner]), n.sum())
    h = np.concatenate(sets)
    ones = np.zeros((words, len(n), 64), np.int64)
    for at in range(0, len(owner), 256):
        edge = start[at : at + 257]
        some = h[edge[0] : edge[-1]]
        for k in range(words):
            bits = np.unpackbits(_words.mix(some + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.uint8))
            sums = np.add.reduceat(bits.view(np.uint64).reshape(-1, 8), edge[:-1] - edge[0], axis=0)
            np.add.at(ones[k], owner[at : at + 256], sums.view(np.uint8))
    return np.packbits(2 * ones > n[:, None], axis=2).view(np.uint64)[:, :, 0].T


def cells(fp: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """The cell of each fingerprint in each band: the band's number, then its bits."""
    unpacked = np.unpackbits(np.ascontiguousarray(fp[:, CHECK_WORDS:]).view(np.uint8), axis=1)[:, : bits * bands].reshape(len(fp), bands, bits)
    return (np.arange(bands) << bits) + unpacked @ (1 << np.arange(bits))


def cell_stars(cell: np.ndarray, pid: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, n): in whole cells, the groups that CHECK_DISTANCE connects: smallest member, member, number of members. check: a row of words each.

    Every row is compared with all after it in its cell but those that are connected to it already, one offset at a time.
    """
    order = np.lexsort((pid, cell))
    cell, pid, check = cell[order], pid[order], check[order].T.copy()
    end = np.searchsorted(cell, cell, side="right")
    root = np.arange(len(cell))
    offset, left = 1, np.flatnonzero(end > root + 1)
    while len(left):
        a = left[root[left] != root[left + offset]]
        b = a + offset
        near = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int16) for w in check) <= CHECK_DISTANCE
        a, b = a[near], b[near]
        while len(a := a[root[a] != root[b]]):
            b = a + offset
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while (root[root] != root).any():
                root = root[root]
        offset += 1
        left = left[end[left] > left + offset]
    n = np.bincount(root, minlength=len(root))[root]
    many = n > 1
    return pid[root[many]], pid[many], n[many]


def _in_cells(fingerprinted: DataFrame, bits: int, bands: int) -> DataFrame:
    """(bucket, pid, c0, ...): each text in the cell of each of its bands, with the words that are compared. fingerprinted: (pid, f0, ...)."""
    words = [c for c in fingerprinted.columns if c != "pid"]
    names = ["bucket", "pid", *(f"c{k}" for k in range(CHECK_WORDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                fp = np.stack([part.column(c).to_numpy() for c in words], axis=1)
                each = [part.column("pid").to_numpy(), *fp.T[:CHECK_WORDS]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cells(fp, bits, bands).ravel(), *(np.repeat(x, bands) for x in each))], names=names)

    return fingerprinted.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _compared(filed: DataFrame) -> DataFrame:
    """(u, v, n): cell_stars() of all cells, dealt by cell; a task holds ROWS_AT_ONCE rows and one cell. filed: as _in_cells() makes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: np.ndarray) -> pa.RecordBatch:
            u, v, n = cell_stars(rows[:, 0], rows[:, 1], rows[:, 2:].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n)], names=["u", "v", "n"])

        held, size = [], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            size += batch.num_rows
            if size >= ROWS_AT_ONCE:
                rows = np.concatenate(held)
                whole = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
                yield found(rows[:whole])
                held, size = [rows[whole:]], len(rows) - whole
        if held:
            yield found(np.concatenate(held))

    return filed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u bigint, v bigint, n bigint")


def candidates(fingerprinted: DataFrame, bits: int, bands: int, tmp: _shared.Scratch, lost: DataFrame | None = None) -> DataFrame:
    """(u, v, n): stars that connect the texts whose fingerprints are near, and those of `lost`. fingerprinted: (pid, f0, ...), each pid once, from a written table."""
    filed = _in_cells(fingerprinted, bits, bands)
    crowds = tmp(filed.groupBy("bucket").count().where(F.col("count") > CROWD).select("bucket"))
    if not crowds.limit(1).count():
        found = _compared(filed)
    else:
        found = _compared(filed.join(crowds, "bucket", "left_anti")).union(paragraph_minhash.stars(filed.select("pid", "bucket").join(crowds, "bucket", "left_semi")))
    return _lean(found if lost is None else found.union(lost))


def whole(own: DataFrame, documents: DataFrame, tmp: _shared.Scratch) -> DataFrame:
    """(u, v, n): stars of texts that links of the similarity connect, by the exact set join, so that none is lost that fingerprints or bands miss. own: (pid, rep)."""
    exact = jaccard_trie.similar(documents.where("doc_id is not null").select("doc_id", "text")).select("doc_id", "component_id").distinct()
    return paragraph_minhash.stars(tmp(own.join(exact, own["rep"] == exact["doc_id"]).select("pid", F.col("component_id").alias("bucket"))))


def _lean(found: DataFrame) -> DataFrame:
    """The same components and sums of n by fewer links: a member of many stars stays in the one with the smallest centre, the other centres join that one."""
    by = found.groupBy("v").agg(F.collect_set("u").alias("centres"), F.sum("n").alias("n")).withColumn("u", F.array_min("centres"))
    members = F.expr("array(struct(v, n))")
    others = F.expr("transform(filter(centres, c -> c <> u and c <> v), c -> struct(c as v, 0L as n))")
    return by.select("u", F.explode(F.concat(members, others)).alias("m")).select("u", "m.v", "m.n")


def _text_rows(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, pid (stands for a set of shingles) and fingerprint of every row with an id; a null text is an empty one."""
    names = [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.chunks(batches):
            own, pid = text_shingles(texts)
            fp = wide_fingerprints(own, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pid), *(pa.array(fp[:, k]) for k in range(words))], names=["doc_id", "pid", *names])

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, pid bigint, " + ", ".join(f"{n} bigint" for n in names))


def text_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pid, sets) of wanted texts; wanted: (doc_id, pids) as in paragraph_minhash.line_sets()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.chunks(batches):
            own, pid = text_shingles(texts)
            pick = [k for k, (p, asked) in enumerate(zip(pid.tolist(), part.column("pids").to_pylist(), strict=True)) if p in asked]
            yield pa.RecordBatch.from_arrays([pa.array(pid[pick]), pa.array([own[k].tobytes() for k in pick], pa.binary())], names=["pid", "sets"])

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(wanted.hint("merge"), "doc_id").select("text", "pids").mapInArrow(run, "pid bigint, sets binary")


def near_copies(documents: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over texts of the similarity) of every row with an id."""
    bits, bands = bands_of(documents.where("doc_id is not null").count())
    words = CHECK_WORDS + -(-bits * bands // 64)
    rows = _shared.written(_text_rows(documents, words))
    names = [f"f{k}" for k in range(words)]
    with _shared.Scratch() as tmp:
        own = tmp(rows.groupBy("pid").agg(F.min("doc_id").alias("rep"), *(F.min(n).alias(n) for n in names)))
        lost = whole(own.select("pid", "rep"), documents, tmp)
        found = paragraph_minhash.candidates(candidates(own.select("pid", *names), bits, bands, tmp, lost), tmp)
        cluster = paragraph_minhash.clusters(found, paragraph_minhash.sets_of(own.select("pid", "rep"), documents, text_sets, tmp), tmp)
        named = own.join(cluster, own["pid"] == cluster["node"], "left").select("pid", "rep", F.coalesce("component", "pid").alias("component"))
        least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        of = _shared.written(named.join(least, "component").select("pid", "component_id"))
    return rows.select("doc_id", "pid").join(of, "pid").select("doc_id", "component_id")


# ---- what stays


def survivors(documents: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row of each component: that with the smallest doc_id. ids: (doc_id, component_id), those of near_duplicates() unless given. Repeated rows of an id and text are one; null ids stay.

    Ids decide, so texts move only in the join that keeps them, and again only where ids repeat at all.
    """
    ids = ids if ids is not None else near_duplicates(documents.select("doc_id", "text"))
    kept = _shared.written(ids.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")))
    found = documents.join(kept.select("doc_id").hint("merge"), "doc_id", "left_semi")
    if kept.where("rows > 1").limit(1).count():
        found = found.dropDuplicates(["doc_id", "text"])
    return found.union(documents.where("doc_id is null"))
