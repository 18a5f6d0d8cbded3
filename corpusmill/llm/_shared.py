"""Connected components over written tables, and names that no column has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.storage import Scratch, Written, shared_folder, written  # noqa: F401
from corpusmill.storage import kept as _kept


def free_name(columns: Iterable[str], name: str) -> str:
    """`name`, with underscores in front until no column has it (Spark's names ignore case)."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name = "_" + name
    return name


def components(edges: DataFrame, tmp: Scratch | None = None) -> DataFrame:
    """(node, component) of every node of the undirected edges (u, v); component: its smallest node. The result is a table of `tmp`, if given.

    Alternating large and small stars (Kiveris et al. 2014): every round points nodes at their smallest neighbour, so paths
    shrink to stars in about log(length) rounds. Minima are combined before each shuffle, so a node with very many
    neighbours costs no task more than its share; the joins that follow are ones that adaptive execution splits.
    """
    now = Written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        tasks = 1 + now.read().count() // EDGES_A_TASK
        nxt = Written(_small_star(_large_star(now.read(), tasks), tasks))
        state = nxt.read().agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now.drop()
        now = nxt
        if seen == tuple(state):
            break
        seen = tuple(state)
    (_kept if tmp is None else tmp.tables).append(now)
    stars = now.read()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v")).distinct()


#: Parts into which the neighbours of one node are dealt in joins; edges that a task of a round takes, so that small graphs make few files.
HUB_PARTS, EDGES_A_TASK = 32, 50_000


def _part(column: str) -> str:
    return f"cast(pmod(xxhash64({column}), {HUB_PARTS}) as int)"


def _dealt(e: DataFrame, least: DataFrame, other: str, tasks: int) -> DataFrame:
    """e joined with least (u, m, parts) on u, a hub's edges in parts by `other`; `parts` has a bit for every part that occurs."""
    each = F.expr(f"explode(filter(sequence(0, {HUB_PARTS - 1}), p -> shiftright(parts, p) & 1L = 1))").alias("part")
    return e.withColumn("part", F.expr(_part(other))).join(least.select("u", "m", each).coalesce(tasks), ["u", "part"])


def _large_star(e: DataFrame, tasks: int) -> DataFrame:
    """Larger neighbours of each node move to its smallest neighbour or itself. e: u > v, each pair once."""
    both = e.select("u", "v", F.lit(0).cast("long").alias("bit")).union(e.select(F.col("v").alias("u"), F.col("u").alias("v"), F.expr(f"shiftleft(1L, {_part('u')})")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.bit_or("bit").alias("parts")).select("u", F.least("u", "m").alias("m"), "parts")
    moved = _dealt(e.select(F.col("v").alias("u"), F.col("u").alias("w")), least, "w", tasks)
    return moved.select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)


def _small_star(e: DataFrame, tasks: int) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.bit_or(F.expr(f"shiftleft(1L, {_part('v')})")).alias("parts"))
    moved = _dealt(e, least, "v", tasks).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
