"""Windows over keys that are too busy for one task, and over all rows in order.

Rows are put in global order by key and time, numbered, and cut into slices of equal size. A
slice also gets the last rows of the one before, or the first of the one after, where a frame
needs them; running sums start from what the slices before have come to. So a task's work is
bounded by the slice, whatever a key's share of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vigilframe.operators.sets import placed
from vigilframe.session import materialize

#: Rows beyond which a key is cut into slices, and rows of a slice.
HOT_ROWS, SLICE_ROWS = 1_000_000, 65_536
PLACE, SLICE = "__place", "__slice"
#: Rows of a wide table that one task sorts, about, and rows below which it isn't worth another task.
TASK_ROWS, LEAST_ROWS = 65_536, 8_192

Build = Callable[[WindowSpec], dict[str, Column]]


@dataclass(frozen=True)
class Hot:
    """The values of a key column that have more than HOT_ROWS rows; no table where there are none."""

    key: str
    keys: DataFrame | None


def tasks_for(df: DataFrame, rows: int) -> int:
    """Partitions for a shuffle of so many rows: more rows make more tasks, not larger ones."""
    return max(1, math.ceil(rows / TASK_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / LEAST_ROWS)))


def hot_keys(df: DataFrame, key: str) -> Hot:
    """Counts the rows of each key; not where the plan's own estimate leaves no room for so many rows of a few bytes."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 8 * HOT_ROWS:
        return Hot(key, None)
    counts = df.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("n"))
    found = materialize(counts.where(F.col("n") > HOT_ROWS).select("__hot"), "hot-keys")
    return Hot(key, None if found.isEmpty() else found)


def apart(df: DataFrame, hot: Hot, work: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """work(rows, False) on the rows of ordinary keys and work(rows, True) on those of hot ones, together."""
    if hot.keys is None:
        return work(df, False)
    # Written, so that neither branch repeats what comes before, however many of them follow each other.
    df = materialize(df, "apart")
    mine = df[hot.key].eqNullSafe(hot.keys["__hot"])
    return work(df.join(hot.keys, mine, "left_anti"), False).unionByName(work(df.join(hot.keys, mine, "left_semi"), True))


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], back: int = 0, forward: int = 0, size: int | None = None) -> DataFrame:
    """df with PLACE, its number from 1 in order of keys and order, SLICE, of size rows, and __own.

    The last `back` rows of a slice are also in the next one, the first `forward` in the one
    before; there __own is false.
    """
    rows, size = placed(df, [*keys, *order], PLACE), max(size or SLICE_ROWS, back, forward)
    at, of = F.pmod(F.col(PLACE) - 1, F.lit(size)), F.floor((F.col(PLACE) - 1) / size)
    copies = [F.struct(of.alias("s"), F.lit(True).alias("own"))]
    copies += [F.when(at >= size - back, F.struct((of + 1).alias("s"), F.lit(False).alias("own")))] if back else []
    copies += [F.when(at < forward, F.struct((of - 1).alias("s"), F.lit(False).alias("own")))] if forward else []
    if len(copies) == 1:
        return rows.withColumns({SLICE: of, "__own": F.lit(True)})
    rows = rows.withColumn("__copy", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
    return rows.withColumns({SLICE: F.col("__copy.s"), "__own": F.col("__copy.own")}).drop("__copy")


def rows_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], build: Build, back: int = 0, forward: int = 0, by_slices: bool = False) -> DataFrame:
    """df with the columns that build makes over an ordered window of each key.

    Their frames reach at most `back` rows before and `forward` rows after a row.
    """
    if not by_slices:
        return df.withColumns(build(Window.partitionBy(*keys).orderBy(*order)))
    rows = sliced(df, keys, order, back, forward)
    out = rows.withColumns(build(Window.partitionBy(SLICE, *keys).orderBy(PLACE)))
    return out.where("__own").drop(PLACE, SLICE, "__own")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str], by_slices: bool = False) -> DataFrame:
    """df with {new column: running sum of a column} over each key, the row itself included."""
    before = (Window.unboundedPreceding, Window.currentRow)
    if not by_slices:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
        return df.withColumns({out: F.sum(c).over(upto) for out, c in sums.items()})
    rows = sliced(df, keys, order)
    rows = rows.withColumns({out: F.sum(c).over(Window.partitionBy(SLICE, *keys).orderBy(PLACE).rowsBetween(*before)) for out, c in sums.items()})
    totals = rows.groupBy(F.col(SLICE).alias("__s"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(*[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums.values())])
    earlier = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each key and slice.
    carried = totals.withColumns({f"__c{i}": F.coalesce(F.sum(f"__t{i}").over(earlier), F.lit(0)) for i in range(len(sums))})
    same = reduce(lambda a, b: a & b, [rows[SLICE] == carried["__s"], *[rows[k].eqNullSafe(carried[f"__k{i}"]) for i, k in enumerate(keys)]])
    out = rows.join(carried, same).withColumns({name: F.col(name) + F.col(f"__c{i}") for i, name in enumerate(sums)})
    return out.drop(PLACE, SLICE, "__own", "__s", *carried.columns)
