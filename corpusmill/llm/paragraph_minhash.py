"""Substring dedup: passages that repeat across documents are cut from all but the first that holds them.

Paragraphs of whole texts are banded by MinHash, those that share a band are joined, their words decide, and connected components of
accepted pairs are the clusters; a cluster keeps its paragraph in its first document. There are two kinds, from one pass over the texts:

* Lines of PASSAGE_WORDS or more words: BANDS bands of ROWS minima over five-word shingles bring two lines of Jaccard similarity
  0.8 together with probability 1 - (1 - 0.8**2)**8 = 0.9997; their exact similarity decides.
* Segments: every text is also divided where its words say so (at local minima of a hash of five words, about RADIUS * 2 + 1
  words apart), so a passage inside other text is divided alike wherever it stands. So short a paragraph reaches the similarity
  only if it is equal but for an end, so it has one band of all its rows: the BLAKE2b-128 digest of its words, which also verifies them.

Lines and segments that an earlier document holds are put together, and a stretch of PASSAGE_WORDS or more is cut; shorter
repetition is ordinary language and stays. The context decides where the first and last segment of a passage end, so up to about
a dozen words at either end may stay; a passage of 51 words that stands inside other text leaves a stretch of PASSAGE_WORDS in
97 % of cases, one of 60 in 99.97 %.

Equal paragraphs are one before any pairing. Those that share a band form candidate components. One of at most BUCKET paragraphs
is verified in one task (all its pairs but those that are connected already or share none of their rarest shingles, which can't
have the similarity). A larger one (texts with a common line, families of near copies) is first divided by the same rule: each member
names its rarest shingles, by counts in CELLS cells, and those that share one form components anew, so what is merely common
connects nothing. A component that is still larger is compared with its best-connected members through joins (no task holds it), in up to
LEADERS rounds; then it is dealt into blocks, and every pair of blocks meets in a task of its own, save those inside its
largest cluster: only what is like its neighbours but not like the leaders costs more than its share. No pair is left out.
A paragraph that very many documents hold is joined back in SALTS parts. No hash of a document reaches the driver.

Defined cases: null and empty texts keep their value and cut nothing; rows with a null id are left as they are; rows that
repeat an id are one document (each row's own text is cut), and a document never loses a passage to itself; ties go to the smaller
doc_id; a very long text is one task's work, never cut short; an empty table gives an empty result; all columns pass through,
and what the operator finds is one struct column whose name the caller chooses.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import _shared, _words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 8, 2
PASSAGE_WORDS, RADIUS = 24, 4
BUCKET, LEADERS, SALTS, CELLS = 512, 3, 32, 1 << 20

_rng = np.random.default_rng(99)
_MULT = _rng.integers(1, 1 << 63, 48, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # the first BANDS * ROWS are used
_ADD = _rng.integers(0, 1 << 63, 48, dtype=np.uint64)


# ---- paragraphs of texts


def shingles(w: _words.Words) -> np.ndarray:
    """Hash of the five words that begin at each word; the largest number where a text ends before."""
    h = np.full(len(w), np.iinfo(np.uint64).max, np.uint64)
    grams, at = _words.windows(w, SHINGLE)
    h[at] = grams
    return h


def lines(w: _words.Words, least: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last word of every line of `least` words or more."""
    breaks = np.searchsorted(w.start, np.flatnonzero(w.data == 10))
    edge = np.unique(np.concatenate([w.first, breaks]))
    start, end = edge[:-1], edge[1:]
    keep = end - start >= least
    return start[keep], end[keep]


def segments(w: _words.Words, h: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last word of every segment; together they are the whole texts."""
    cut = h < np.iinfo(np.uint64).max
    for k in range(1, radius + 1):
        same = w.doc[k:] == w.doc[:-k]
        cut[k:] &= ~same | (h[k:] < h[:-k])
        cut[:-k] &= ~same | (h[:-k] <= h[k:])
    edge = np.unique(np.concatenate([w.first, np.flatnonzero(cut)]))
    return edge[:-1], edge[1:]


def digests(w: _words.Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """BLAKE2b-128 of the words of each range, with a space after each, as two longs."""
    data = w.data.copy()
    data[w.end] = 32
    edge = np.zeros(len(data) + 2, np.int8)
    edge[w.start] += 1
    edge[w.end + 1] -= 1
    held = data[np.cumsum(edge[:-2], dtype=np.int8) > 0].tobytes()
    at = np.concatenate([[0], np.cumsum(w.end - w.start + 1)])
    blake = hashlib.blake2b
    both = b"".join([blake(held[a:b], digest_size=16).digest() for a, b in zip(at[start].tolist(), at[end].tolist(), strict=True)])
    return np.frombuffer(both, np.int64).reshape(-1, 2)


def signatures(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """BANDS keys of each range of shingle hashes, none empty; a key hashes ROWS minima. Repeats change no minimum."""
    out = np.zeros((len(start), BANDS), np.uint64)
    if len(start):
        flat, at = np.append(h, np.uint64(0)), np.column_stack([start, end]).ravel()
        for b in range(BANDS):
            for r in range(b * ROWS, (b + 1) * ROWS):
                low = np.minimum.reduceat(flat * _MULT[r] + _ADD[r], at)[::2]
                out[:, b] = _words.mix(out[:, b] * np.uint64(0xD6E8FEB86659FD93) + low + np.uint64(b))
    return out


def _places(texts: list[bytes], w: _words.Words, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of each range: 31 bits of the text's checksum, then the first word's number, so that rows of one id keep apart."""
    doc = w.doc[start] if len(start) else start
    mark = np.array([zlib.crc32(t) >> 1 for t in texts], np.int64)
    return doc, (mark[doc] << 32) + start - w.first[doc]


_BAND_NAMES = [f"b{k}" for k in range(BANDS)]
_ROWS_SCHEMA = "doc_id bigint, place bigint, n int, h1 bigint, h2 bigint, " + ", ".join(f"{b} bigint" for b in _BAND_NAMES)
_ARROW_ROWS = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), *((b, pa.int64()) for b in _BAND_NAMES)])


def _known(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def paragraph_rows(documents: DataFrame) -> DataFrame:
    """One row for every segment (no band) and every line: document, place, number of words, digest, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.chunks(batches):
            w = _words.split_words(texts)
            h = shingles(w)
            for (start, end), banded in ((segments(w, h), False), (lines(w), True)):
                doc, place = _places(texts, w, start)
                digest = digests(w, start, end)
                keys = signatures(h, start, end - SHINGLE + 1).view(np.int64) if banded else None
                bands = [pa.array(keys[:, b]) if banded else pa.nulls(len(start), pa.int64()) for b in range(BANDS)]
                columns = [part.column("doc_id").take(pa.array(doc)), pa.array(place), pa.array((end - start).astype(np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), *bands]
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW_ROWS)

    return _known(documents).mapInArrow(run, _ROWS_SCHEMA)


def line_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pid, sets): the distinct shingles, ascending, of wanted lines; wanted: (doc_id, pids), each a line that the document holds.

    What is wanted grows with the texts, so it isn't broadcast: the join is a shuffle at every size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.chunks(batches):
            w = _words.split_words(texts)
            h = shingles(w)
            start, end = lines(w)
            pid = digests(w, start, end)[:, 0]
            asked = [set(x) for x in part.column("pids").to_pylist()]
            pick = [k for k, (d, p) in enumerate(zip(w.doc[start].tolist() if len(start) else [], pid.tolist(), strict=True)) if p in asked[d]]
            sets = [np.unique(h[a : b - SHINGLE + 1]).tobytes() for a, b in zip(start[pick].tolist(), end[pick].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(pid[pick]), pa.array(sets, pa.binary())], names=["pid", "sets"])

    return _known(documents).join(wanted.hint("merge"), "doc_id").select("text", "pids").mapInArrow(run, "pid bigint, sets binary")


# ---- similar pairs


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending arrays without repeats."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _enough(n: int) -> int:
    """So many members of a set of n, the first in an order that all sets share, that two sets of the similarity always share one of them."""
    return n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1


def _prefixes(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The rarest members of each set, as numbers."""
    _, rank, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(np.argsort(count, kind="stable"), kind="stable")[rank]
    at = np.cumsum([0, *map(len, sets)])
    return [np.sort(order[a:b])[: _enough(b - a)] for a, b in zip(at[:-1], at[1:], strict=True)]


def _alike(size: np.ndarray, other: int) -> np.ndarray:
    """Whether sizes of sets allow the similarity."""
    return np.minimum(size, other) >= SIMILARITY * np.maximum(size, other)


def verify(pid: list[int], sets: list[np.ndarray], cluster: list[int] | None = None) -> list[tuple[int, int]]:
    """Accepted pairs that connect a group: a member is compared with all before it that share a rare shingle and are not yet in its cluster."""
    if len(pid) == 2:
        return [(pid[0], pid[1])] if _alike(np.array(len(sets[0])), len(sets[1])) and jaccard(*sets) >= SIMILARITY else []
    pairs = []
    root = np.unique(np.array(cluster if cluster is not None else pid), return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    prefixes = _prefixes(sets)
    # members in order of (shingle, member): those before a member of the same shingle stand just before it
    flat, who = np.concatenate(prefixes), np.repeat(np.arange(len(sets)), [len(x) for x in prefixes])
    order = np.argsort(flat, kind="stable")
    by, place = who[order], np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = np.searchsorted(flat[order], flat)
    at = np.cumsum([0, *map(len, prefixes)])
    for k in range(1, len(sets)):
        mark = np.zeros(k, bool)
        for a, b in zip(first[at[k] : at[k + 1]].tolist(), place[at[k] : at[k + 1]].tolist(), strict=True):
            mark[by[a:b]] = True
        near = np.flatnonzero(mark)
        near = near[(root[near] != root[k]) & _alike(size[near], size[k])]
        while len(near):
            m, near = near[0], near[1:]
            if jaccard(sets[m], sets[k]) >= SIMILARITY:
                pairs.append((pid[m], pid[k]))
                root[root == root[m]] = root[k]
                near = near[root[near] != root[k]]
    return pairs


def verified(rows: DataFrame) -> DataFrame:
    """(u, v): accepted pairs within each group. rows: (grp, pid, sets) and perhaps cluster; a group has a bounded number of rows.

    Groups are dealt by key and sorted; a task goes through many of them and holds one at a time.
    """
    named = "cluster" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> list[tuple[int, int]]:
            once = {p: (s, c) for p, s, c in held}
            if len(once) < 2:
                return []
            ids = sorted(once)
            return verify(ids, [np.frombuffer(once[p][0], np.uint64) for p in ids], [once[p][1] for p in ids] if named else None)

        held: list[tuple] = []
        group = None
        for batch in batches:
            found = []
            none = [None] * batch.num_rows
            columns = [batch.column(c).to_pylist() if c != "cluster" or named else none for c in ("grp", "pid", "sets", "cluster")]
            for g, p, s, c in zip(*columns, strict=True):
                if g != group:
                    found += flush()
                    held, group = [], g
                held.append((p, s, c))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])
        found = flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "u bigint, v bigint")


def _similar(left: str, right: str) -> Column:
    """A predicate column: whether two set columns have the similarity."""

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= SIMILARITY for x, y in zip(a, b, strict=True)], dtype=bool)

    return test(F.col(left), F.col(right))


def _cells(shingle: np.ndarray) -> np.ndarray:
    return (_words.mix(shingle) % np.uint64(CELLS)).astype(np.int64)


def _rare_keys(members: DataFrame) -> DataFrame:
    """(pid, bucket): the rarest shingles of each member within its group. members: (grp, pid, sets).

    Rarity is by counts of cells, of which there are CELLS at most, whatever the data; any common order keeps every pair.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CELLS, np.int64)
        for batch in batches:
            for s in batch.column("sets").to_pylist():
                np.add.at(held, _cells(np.frombuffer(s, np.uint64)), 1)
        cell = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(held[cell])], names=["cell", "n"])

    counts = np.zeros(CELLS, np.int64)
    found = members.select("sets").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    shared = members.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pids, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for g, p, s in zip(*(batch.column(c).to_pylist() for c in ("grp", "pid", "sets")), strict=True):
                own = np.frombuffer(s, np.uint64)
                few = own[np.lexsort((own, shared.value[_cells(own)]))[: _enough(len(own))]]
                keys.append(_words.mix(few ^ np.uint64(g & (1 << 64) - 1)))
                pids.append(np.full(len(few), p, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(pids)), pa.array(np.concatenate(keys).view(np.int64))], names=["pid", "bucket"])

    return members.mapInArrow(run, "pid bigint, bucket bigint")


def stars(keyed: DataFrame) -> DataFrame:
    """(u, v, n): the smallest of each bucket, its members, and how many they are. keyed: (pid, bucket)."""
    shared = keyed.groupBy("bucket").agg(F.min("pid").alias("lead"), F.max("pid").alias("last"), F.count("*").alias("n")).where("lead < last").select("bucket", "lead", "n")
    return keyed.join(shared, "bucket").select(F.col("lead").alias("u"), F.col("pid").alias("v"), "n")


def candidates(found: DataFrame, tmp: _shared.Scratch) -> DataFrame:
    """(grp, pid, size, weight): components of paragraphs that share a bucket. found: their stars(); weight: members of all its buckets."""
    links = tmp(found.groupBy("u", "v").agg(F.sum("n").alias("n")))
    component = _shared.components(links.select("u", "v"), tmp)
    weight = links.groupBy(F.col("v").alias("node")).agg(F.sum("n").alias("weight"))
    of = tmp(component.join(weight, "node").select(F.col("component").alias("grp"), F.col("node").alias("pid"), "weight"))
    return tmp(of.join(of.groupBy("grp").agg(F.count("*").alias("size")), "grp"))


def _blocks(big: DataFrame, found: DataFrame, tmp: _shared.Scratch) -> DataFrame:
    """(grp, pid, cluster): the blocks in which all pairs of a large group meet, but for those that `found` connects already.

    big: (grp, pid). The largest cluster of a group needs no pairs of its own: its blocks meet those of the rest only.
    """
    cluster = _shared.components(found, tmp)
    placed = big.join(cluster, big["pid"] == cluster["node"], "left").select("grp", "pid", F.coalesce("component", "pid").alias("cluster"))
    sizes = placed.groupBy("grp", "cluster").agg(F.count("*").alias("n"))
    main = sizes.groupBy("grp").agg(F.max(F.struct("n", "cluster")).alias("m"), F.sum("n").alias("n"))
    parts = lambda n: F.ceil(n / max(1, BUCKET // 2)).cast("int")
    main = main.where("n > m.n").select("grp", F.col("m.cluster").alias("main"), parts(F.col("n") - F.col("m.n")).alias("rest"), parts(F.col("m.n")).alias("more"))
    dealt = placed.join(main, "grp").withColumn("hash", F.xxhash64("grp", "pid"))
    own = F.when(F.col("cluster") == F.col("main"), F.col("rest") + F.pmod("hash", "more")).otherwise(F.pmod("hash", "rest")).cast("int")
    last = F.when(F.col("own") < F.col("rest"), F.col("rest") + F.col("more")).otherwise(F.col("rest")) - 1
    met = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int")))).where("own <> other")
    return met.select(F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "pid", "cluster")


def _similar_in_large(big: DataFrame, members: DataFrame, tmp: _shared.Scratch) -> DataFrame:
    """Accepted pairs of groups too large for one task. big: (grp, pid, size, weight)."""
    part = F.pmod(F.xxhash64("pid"), F.ceil(F.col("size") / BUCKET)).cast("int").alias("part")
    held = tmp(big.select("grp", "pid", part).join(members, "pid"))
    rest, found = big, None
    for _ in range(LEADERS):
        lead = rest.groupBy("grp").agg(F.max(F.struct("weight", "pid")).alias("m"), F.max("size").alias("size"))
        each = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / BUCKET) - 1).cast("int"))).alias("part")
        lead = lead.select("grp", F.col("m.pid").alias("leader"), each)
        named = lead.join(members.select(F.col("pid").alias("leader"), F.col("sets").alias("lead_sets")), "leader")
        tried = held.join(named, ["grp", "part"]).where("pid <> leader").select("leader", "pid", _similar("lead_sets", "sets").alias("same"))
        same = tmp(tried.where("same").select(F.col("leader").alias("u"), F.col("pid").alias("v")))
        found = same if found is None else found.union(same)
        done = same.select(F.col("v").alias("pid")).union(lead.select(F.col("leader").alias("pid"))).distinct()
        rest = tmp(rest.join(done, "pid", "left_anti").select(*big.columns))
        if not rest.limit(1).count():
            break
    return found.union(verified(tmp(_blocks(big.select("grp", "pid"), found, tmp)).join(members, "pid")))


def similar(banded: DataFrame, sets: Callable[[DataFrame], DataFrame], tmp: _shared.Scratch) -> DataFrame:
    """(node, component): clusters of paragraphs that accepted pairs connect, those of one paragraph left out.

    banded: (pid, bands), one row a paragraph, from a written table; sets(pids): (pid, sets) of the paragraphs in a table of pids.
    """
    keyed = banded.select("pid", F.posexplode("bands").alias("band", "key")).select("pid", F.xxhash64("band", "key").alias("bucket"))
    return clusters(candidates(stars(keyed), tmp), sets, tmp)


def clusters(cand: DataFrame, sets: Callable[[DataFrame], DataFrame], tmp: _shared.Scratch) -> DataFrame:
    """What similar() returns, from candidates()."""
    members = tmp(sets(cand.select("pid")))
    in_one_task = lambda c: verified(c.where(F.col("size") <= BUCKET).select("grp", "pid").join(members, "pid"))
    pairs, large = in_one_task(cand), cand.where(F.col("size") > BUCKET)
    if large.limit(1).count():
        again = candidates(stars(_rare_keys(large.select("grp", "pid").join(members, "pid"))), tmp)
        pairs, large = pairs.union(in_one_task(again)), again.where(F.col("size") > BUCKET)
        if large.limit(1).count():
            pairs = pairs.union(_similar_in_large(large, members, tmp))
    return _shared.components(pairs.distinct(), tmp)


def sets_of(own: DataFrame, documents: DataFrame, read: Callable[[DataFrame, DataFrame], DataFrame], tmp: _shared.Scratch) -> Callable[[DataFrame], DataFrame]:
    """How similar() gets at the sets: each paragraph is read again from its first document. own: (pid, rep, ...)."""

    def sets(pids: DataFrame) -> DataFrame:
        asked = own.join(pids, "pid", "left_semi").groupBy(F.col("rep").alias("doc_id")).agg(F.collect_set("pid").alias("pids"))
        return read(documents, tmp(asked))

    return sets


# ---- what to cut


_SALT = f"cast(pmod(xxhash64(doc_id), {SALTS}) as int)"


def _salt() -> Column:
    return F.expr(_SALT).alias("salt")


def _salts() -> Column:
    """The salts that occur, as bits."""
    return F.expr(f"bit_or(shiftleft(1L, {_SALT}))").alias("salts")


def _each_salt() -> Column:
    return F.expr(f"explode(filter(sequence(0, {SALTS - 1}), s -> shiftright(salts, s) & 1L = 1))").alias("salt")


def line_spans(rows: DataFrame, documents: DataFrame, tmp: _shared.Scratch) -> DataFrame:
    """(doc_id, place, n, rep): lines whose cluster has an earlier document, rep being its first. rows: those of lines."""
    own = rows.groupBy(F.col("h1").alias("pid")).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), _salts(), *(F.min(b).alias(b) for b in _BAND_NAMES))
    own = tmp(own)
    cluster = similar(own.select("pid", F.array(*_BAND_NAMES).alias("bands")), sets_of(own, documents, line_sets, tmp), tmp)
    placed = own.join(cluster, own["pid"] == cluster["node"], "left").where("component is not null or rep < last").select("pid", "rep", "salts", F.coalesce("component", "pid").alias("component"))
    placed = tmp(placed)
    first = placed.groupBy("component").agg(F.min("rep").alias("rep"))
    dealt = placed.drop("rep").join(first, "component").select("pid", "rep", _each_salt())
    return rows.select("doc_id", "place", "n", F.col("h1").alias("pid"), _salt()).join(dealt, ["pid", "salt"]).where("doc_id > rep").select("doc_id", "place", "n", "rep")


def segment_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, place, n, rep): segments that an earlier document holds. rows: those of segments."""
    first = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), _salts()).where("rep < last")
    dealt = first.select("h1", "h2", "rep", _each_salt())
    return rows.select("doc_id", "place", "n", "h1", "h2", _salt()).join(dealt, ["h1", "h2", "salt"]).where("doc_id > rep").select("doc_id", "place", "n", "rep")


def stretches(spans: DataFrame, least: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, cuts, kept_in): stretches of `least` words or more that spans cover without a gap, as (place, n), and the documents that keep them."""
    w = Window.partitionBy("doc_id").orderBy("place", "n")
    end = F.col("place") + F.col("n")
    run = spans.withColumn("new", (F.col("place") > F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    run = run.withColumn("run", F.sum("new").over(w))
    runs = run.groupBy("doc_id", "run").agg(F.min("place").alias("place"), (F.max(end) - F.min("place")).alias("n"), F.min("rep").alias("rep")).where(F.col("n") >= least)
    return runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.array("place", "n"))).alias("cuts"), F.array_sort(F.collect_set("rep")).alias("kept_in"))


def spans(documents: DataFrame) -> DataFrame:
    """(doc_id, cuts, kept_in) of each document that loses words; a written table."""
    with _shared.Scratch() as tmp:
        rows = tmp(paragraph_rows(documents))
        found = tmp(segment_spans(rows.where("b0 is null")).union(line_spans(rows.where("b0 is not null"), documents, tmp)))
        return _shared.written(stretches(found))


def cut(text: bytes, cuts: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(text without the word ranges, words, words cut). A line that loses its last word goes; other line breaks stay."""
    w = _words.split_words([text], hashed=False)
    drop = np.zeros(len(w), bool)
    for a, b in cuts:
        drop[a:b] = True
    edge = np.flatnonzero(np.diff(drop.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    out, at = [], 0
    for a, b in edge.tolist():
        out.append(text[at : w.start[a]])
        end = int(w.start[b]) if b < len(w) else len(text)
        gap = text[w.end[b - 1] : end]
        whole_lines = (a == 0 or b"\n" in text[w.end[a - 1] : w.start[a]]) and (b == len(w) or b"\n" in gap)
        out.append(b"" if whole_lines else b"\n" if b"\n" in gap else b" " if a and b < len(w) and not text[w.end[a - 1] : w.start[a]] else b"")
        at = end
    out.append(text[at:])
    return b"".join(out), len(w), int(drop.sum())


CUT_TYPE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_cut", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_in", T.ArrayType(T.LongType()))])
_ARROW_CUT = pa.struct([("n_words", pa.int64()), ("n_cut", pa.int64()), ("n_spans", pa.int64()), ("kept_in", pa.list_(pa.int64()))])


def dedup(documents: DataFrame, column: str = "cut") -> DataFrame:
    """The rows with text cut, and a struct `column`: n_words (before), n_cut, n_spans and kept_in (documents that keep what was cut here).

    A column of that name is replaced.
    """
    base = documents.drop(column)
    found = _shared.free_name(base.columns, "_found")
    marks = spans(documents).select("doc_id", F.struct("cuts", "kept_in").alias(found))
    key = _shared.free_name([*base.columns, found], "_doc")
    marked = base.join(marks.withColumnRenamed("doc_id", key).hint("merge"), F.col("doc_id") == F.col(key), "left").drop(key)
    schema = T.StructType([*base.schema.fields, T.StructField(column, CUT_TYPE)])
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.chunks(batches):
            new, rows = [], []
            count = np.diff(_words.split_words(texts, hashed=False).first)
            for k, (text, mark) in enumerate(zip(texts, part.column(found).to_pylist(), strict=True)):
                own = zlib.crc32(text) >> 1 if mark else 0
                cuts = [(place & 0xFFFFFFFF, (place & 0xFFFFFFFF) + n) for place, n in mark["cuts"] if place >> 32 == own] if mark else []
                done, words, gone = cut(text, cuts) if cuts else (text, int(count[k]), 0)
                new.append(done.decode("utf-8", "replace") if part.column("text")[k].is_valid else None)
                rows.append({"n_words": words, "n_cut": gone, "n_spans": len(cuts), "kept_in": mark["kept_in"] if cuts else []})
            yield pa.RecordBatch.from_arrays([*(pa.array(new, pa.string()) if c == "text" else part.column(c) for c in names), pa.array(rows, _ARROW_CUT)], names=[*names, column])

    return marked.mapInArrow(run, schema)
