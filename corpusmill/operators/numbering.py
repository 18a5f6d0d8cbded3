"""Running numbers over a whole table, or within each of its groups, without a task that sees them all.

Rows are dealt into ranges of the order and sorted there; a count for each range gives, added up, where the next one begins. Rows that tie
are dealt by a number of their own, so repeats of one row don't meet in one task. The driver holds one count for each range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import storage

_TIE, _AT = "__tie", "__at"
_ROW_BITS = 33  # monotonically_increasing_id() has the row within its partition in so many low bits


def _part() -> Column:
    return F.shiftright(_AT, _ROW_BITS).cast("int")


def _placed(rows: DataFrame, order: Sequence[str | Column], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows in ranges of the order, written, with __at: range and place in it, as monotonically_increasing_id() gives them."""
    keys = [*order, _TIE]
    dealt = rows.withColumn(_TIE, F.monotonically_increasing_id())
    return keep(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(_TIE).withColumn(_AT, F.monotonically_increasing_id()))


def _begins(placed: DataFrame, size: Column, first: int) -> DataFrame:
    """(__part, __begin): what all ranges before one add up to, from `first`. The driver holds a row for each range."""
    sums = sorted(tuple(r) for r in placed.groupBy(_part().alias("part")).agg(F.sum(size).alias("n")).collect())
    starts = accumulate((int(n or 0) for _, n in sums), initial=first)
    return F.broadcast(placed.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sums, starts, strict=False)] or [(0, first)], "__part int, __begin bigint"))


def numbered(rows: DataFrame, order: Sequence[str | Column], within: Sequence[str] = (), column: str = "number", first: int = 1, keep: Callable[[DataFrame], DataFrame] = storage.written) -> DataFrame:
    """The rows with `column`: their place in `order`, from `first`. Nulls come first, ties in any order.

    within: columns with which `order` has to begin; numbers start anew in each of their groups, and `column`_of is the group's size.
    keep: how the ordered rows are written (a Scratch, or a table that stays as long as the program).
    """
    own = [c for c in rows.columns if c not in (column, f"{column}_of")]
    placed = _placed(rows.select(*own), order, keep)
    number = F.col("__begin") + F.col(_AT).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    found = placed.withColumn("__part", _part()).join(_begins(placed, F.lit(1), first), "__part").select(*own, number.alias(column))
    if not within:
        return found
    groups = found.groupBy(*(F.col(c).alias(f"__{c}") for c in within)).agg(F.min(column).alias("__first"), F.count("*").alias(f"{column}_of"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in within))
    return found.join(groups, same).select(*own, (F.col(column) - F.col("__first") + first).alias(column), f"{column}_of")


def offsets(rows: DataFrame, order: Sequence[str | Column], size: str, column: str = "offset", keep: Callable[[DataFrame], DataFrame] = storage.written) -> DataFrame:
    """The rows with `column`: the sum of `size` over all rows before them in `order`. A null size counts as none.

    A range's sums run through its rows as they stream by.
    """
    own = [c for c in rows.columns if c != column]
    tie = [*order, _TIE]
    dealt = rows.select(*own).withColumn(_TIE, F.monotonically_increasing_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            sizes = b.column(size).cast(pa.int64()).fill_null(0).to_numpy()
            before = total + np.cumsum(sizes) - sizes
            total += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(before)], names=[*own, "__before"])

    summed = dealt.repartitionByRange(*tie).sortWithinPartitions(*tie).drop(_TIE).mapInArrow(run, f"{fields}, __before bigint")
    placed = keep(summed.withColumn(_AT, F.monotonically_increasing_id()))
    return placed.withColumn("__part", _part()).join(_begins(placed, F.col(size), 0), "__part").select(*own, (F.col("__before") + F.col("__begin")).alias(column))
