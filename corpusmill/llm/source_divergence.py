"""Source divergence audit: how far the word use of every source of a language is from every other source, and which terms make it so.

Counts of terms are combined in tasks and again before the shuffle; the terms that enough documents of a language hold are numbered in
their order (by ranges, see operators.numbering). Numbers are cut into shards of SHARD terms, and a group (a language and source) has one
compressed vector of counts for each shard.

Systolic rotation: the groups of a language are seated in teams of TEAM. The vectors of a team and shard stay in their partition, one shuffle
for all rounds, while those of the other teams circulate: in every round of a round-robin tournament (circle method) each team meets
one other, and a meeting evaluates all its pairs in both directions. A round at home compares the members of a team with each other, and with
the vector of the whole language; there a heap for each group and shard keeps its highest terms. Partial sums are added up over shards. A
meeting holds 2 * TEAM * SHARD counts, whatever the size of groups; a language with one source of a third of all rows has no larger task.

All numbers are exact: p is worked out by long division, and sums of f stay below 10**9 * (10**9 + number of terms).

Defined cases: a null text, language or source is an empty one; a text without terms makes its group occur; a language without kept terms has
pairs of value 0; the only source of a language has no pairs; repeated rows are documents of their own; ties go to the item that
comes first in UTF-8; an empty table gives an empty result; texts of any length count whole; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import _shared, _words
from corpusmill.operators.numbering import numbered

SCALE = 10**9
LEAST_DOCS, TOP_TERMS = 3, 200
SHARD, TEAM, ROUNDS_A_JOB = 1 << 14, 8, 8

#: Text that is counted at once before rows leave a task.
COUNT_BYTES = 1 << 22

LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True  # after lower-casing A-Z


# ---- counts


def _unique_counts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(code, return_counts=True)


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents), summed up by group and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _words.chunks(batches, size=COUNT_BYTES):
            w = _words.split_words(texts, LETTERS, hashed=False)
            if not len(w):
                continue
            at = np.zeros(len(w) + 1, np.int32)
            np.cumsum(w.end - w.start, out=at[1:])
            words = pa.BinaryArray.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(at), pa.py_buffer(w.data[LETTERS[w.data]])]).dictionary_encode()
            term, size = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
            pairs: dict[tuple[str, str], int] = {}
            group = np.array([pairs.setdefault(p, len(pairs)) for p in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)], np.int64)
            code, n = _unique_counts(group[w.doc] * size + term)
            own = np.unique(w.doc * size + term)
            docs = _unique_counts(group[own // size] * size + own % size)[1]
            names = list(pairs)
            which = pa.array((code // size).astype(np.int32))
            columns = [pa.array([p[k] for p in names], pa.string()).take(which) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, words.dictionary.take(pa.array(code % size)).cast(pa.string()), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])

    found = _plain(documents, "lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _plain(documents: DataFrame, *names: str) -> DataFrame:
    return documents.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in names))


# ---- vectors


def pack(place: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending places and their counts, compressed."""
    return zlib.compress(np.diff(place, prepend=0).astype(np.int32).tobytes() + n.astype(np.int64).tobytes(), 1)


def unpack(vector: bytes | None, width: int) -> np.ndarray:
    """The counts at all places."""
    full = np.zeros(width, np.int64)
    if vector:
        raw = zlib.decompress(vector)
        m = len(raw) // 12
        full[np.cumsum(np.frombuffer(raw, np.int32, m))] = np.frombuffer(raw, np.int64, m, 4 * m)
    return full


def vectors(entries: DataFrame, *keys: str) -> DataFrame:
    """keys, shard, vector and total of entries (keys, number, n)."""
    shard = F.floor(F.col("number") / SHARD).cast("bigint").alias("shard")
    lists = entries.groupBy(*keys, shard).agg(F.collect_list(F.struct((F.col("number") % SHARD).cast("int").alias("place"), "n")).alias("e"), F.sum("n").alias("total"))
    names = [*keys, "shard", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("e")
            edge = lists.offsets.to_numpy()
            place, n = (lists.values.field(c).to_numpy() for c in ("place", "n"))
            out = []
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                order = np.argsort(place[a:z])
                out.append(pack(place[a:z][order], n[a:z][order]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, "vector"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lists.select(*names).schema)
    return lists.mapInArrow(run, f"{fields}, vector binary")


def likelihood(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / (total + terms)), by long division to base 1000, so that nothing overflows."""
    below, left, p = total + terms, n + 1, np.zeros(len(n), np.int64)
    for _ in range(3):
        left = left * 1000
        p = p * 1000 + left // below
        left = left % below
    return p + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


# ---- meetings


_FOUND = "part string, lang string, source string, item string, number bigint, value bigint"
_ARROW_FOUND = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("number", pa.int64()), ("value", pa.int64())])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), _ARROW_FOUND, strict=True)] if rows else [pa.array([], f.type) for f in _ARROW_FOUND], schema=_ARROW_FOUND)


def _seated(table: pa.Table) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(source, counts, p) of a team's members."""
    rows = table.select(["source", "vector", "width", "total", "terms"]).to_pylist()
    counts = [unpack(r["vector"], r["width"]) for r in rows]
    return [(r["source"], n, likelihood(n, r["total"], r["terms"])) for r, n in zip(rows, counts, strict=True)]


def _pairs(lang: str, a: tuple, b: tuple) -> list[tuple]:
    """Both directions of one meeting of two groups."""
    return [("pair", lang, x[0], y[0], None, int(divergence(x[2], y[2]).sum())) for x, y in ((a, b), (b, a))]


def meeting(home: pa.Table, guests: pa.Table) -> pa.Table:
    """All pairs of two teams over one shard."""
    if not home.num_rows or not guests.num_rows:
        return _table([])
    lang, visiting = home.column("lang")[0].as_py(), _seated(guests)
    return _table([row for a in _seated(home) for b in visiting for row in _pairs(lang, a, b)])


def at_home(home: pa.Table, whole: pa.Table) -> pa.Table:
    """Pairs within a team over one shard, and each member's highest terms against the whole language (one row)."""
    members, lang = _seated(home), home.column("lang")[0].as_py()
    found = [row for k, a in enumerate(members) for b in members[k + 1 :] for row in _pairs(lang, a, b)]
    if whole.num_rows:
        q, first = _seated(whole)[0][2], whole.column("base")[0].as_py()
        for source, n, p in members:
            place = np.flatnonzero((n > 0) & (p > q))
            value = divergence(p[place], q[place])
            top = heapq.nsmallest(TOP_TERMS, zip((-value).tolist(), place.tolist(), strict=True))
            found += [("term", lang, source, None, first + at, -v) for v, at in top]
    return _table(found)


def partner(team: Column, turn: int, rounds: Column) -> Column:
    """Whom a team meets in a round of the circle method; rounds: one less than the (even) number of seats."""
    other = F.pmod(F.lit(turn) - team, rounds)
    last = F.when(F.lit(turn % 2 == 0), F.lit(turn // 2)).otherwise(((F.lit(turn) + rounds) / 2).cast("bigint"))
    return F.when(team == rounds, last).when(other == team, rounds).otherwise(other)


def _rotation(seats: DataFrame, whole: DataFrame, tmp: _shared.Scratch) -> DataFrame:
    """What all meetings find. seats: (lang, shard, team, teams, source, vector, width, total, terms); whole: such rows of languages (no team)."""
    names = ["lang", "shard", "team", "source", "vector", "width", "total", "terms"]
    key = ["lang", "shard", "team"]
    home = seats.select(*names).groupBy(*key)
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("teams") - 1)).alias("team")
    base = (F.col("shard") * SHARD).alias("base")
    languages = whole.select("lang", "shard", each, F.lit(None).cast("string").alias("source"), "vector", "width", "total", "terms", base)
    found = [home.cogroup(languages.groupBy(*key)).applyInArrow(at_home, _FOUND)]
    most = seats.agg(F.max("teams")).first()[0] or 1
    rounds = F.col("teams") + F.col("teams") % 2 - 1
    done = []
    for turn in range(most + most % 2 - 1 if most > 1 else 0):
        met = seats.withColumn("met", partner(F.col("team"), turn, rounds)).where((F.lit(turn) < rounds) & (F.col("met") < F.col("team")) & (F.col("team") < F.col("teams")))
        guests = met.select("lang", "shard", F.col("met").alias("team"), *names[3:])
        found.append(home.cogroup(guests.groupBy(*key)).applyInArrow(meeting, _FOUND))
        if len(found) == ROUNDS_A_JOB:
            done.append(_added(found, tmp))
            found = []
    return _added([*done, *found], tmp)


def _added(found: list[DataFrame], tmp: _shared.Scratch) -> DataFrame:
    """Partial sums of some rounds, written."""
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    return tmp(rows.groupBy("part", "lang", "source", "item", "number").agg(F.sum("value").alias("value")))


def audit(documents: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: every other source of the language, and the TOP_TERMS terms above the language's use."""
    with _shared.Scratch() as tmp:
        counted = tmp(term_counts(documents))
        kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
        terms = tmp(numbered(kept.select("lang", "term", "n"), ["lang", "term"], ["lang"], first=0, keep=tmp))
        own = tmp(vectors(counted.select("lang", "source", "term", "n").join(terms.select("lang", "term", "number"), ["lang", "term"]), "lang", "source"))
        shared = tmp(vectors(terms.select("lang", "number", "n"), "lang"))

        sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
        totals = own.groupBy("lang", "source").agg(F.sum("total").alias("total"))
        groups = numbered(_plain(documents, "lang", "source").distinct(), ["lang", "source"], ["lang"], first=0, keep=tmp)
        groups = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "total"])
        team, teams = F.floor(F.col("number") / TEAM).cast("bigint").alias("team"), F.ceil(F.col("number_of") / TEAM).cast("bigint").alias("teams")
        shard = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("terms") / SHARD) - 1).cast("bigint"))).alias("shard")
        width = F.least(F.lit(SHARD), F.col("terms") - F.col("shard") * SHARD).cast("int").alias("width")
        seats = groups.select("lang", "source", team, teams, "terms", "total", shard).join(own.drop("total"), ["lang", "source", "shard"], "left")
        seats = tmp(seats.select("*", width))

        languages = shared.groupBy("lang").agg(F.sum("total").alias("total")).join(sizes, "lang").join(seats.groupBy("lang").agg(F.max("teams").alias("teams")), "lang")
        whole = shared.drop("total").join(languages, "lang").select("*", width)
        found = _rotation(seats, tmp(whole), tmp)

        names = terms.select(F.col("lang").alias("l"), F.col("number").alias("k"), "term")
        rank = lambda *then: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), *then)).alias("rank")
        top = found.where("part = 'term'").select("*", rank("number")).where(F.col("rank") <= TOP_TERMS)
        top = top.join(names, (F.col("lang") == F.col("l")) & (F.col("number") == F.col("k"))).select("lang", "source", "part", F.col("term").alias("item"), "value", "rank")
        pairs = found.where("part = 'pair'").select("lang", "source", "part", "item", "value", rank("item"))
        return _shared.written(pairs.union(top))
