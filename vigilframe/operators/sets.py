"""Row sets: unions, samples, differences and quality checks of an event table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.scalars import first_truthy, steady_id
from vigilframe.schema import EVENT, REQUIRED, TEXT_COLUMNS, UNKNOWN
from vigilframe.session import materialize

#: Rows that one task may gather.
FEW = 100_000


def standardize(df: DataFrame) -> DataFrame:
    """The canonical columns in order: absent ones null, times that don't parse null. row_id passes through."""
    columns = [(F.col(c).try_cast(kind) if c in df.columns else F.lit(None).cast(kind)).alias(c) for c, kind in EVENT.items()]
    return df.select(*(["row_id"] if "row_id" in df.columns else []), *columns)


def validate(df: DataFrame) -> bool:
    """Whether there are rows and every required column exists with a value somewhere."""
    if any(c not in df.columns for c in REQUIRED):
        return False
    counts = df.agg(*[F.count(c).alias(c) for c in REQUIRED]).first()
    return all(counts[c] > 0 for c in REQUIRED)


def clean(df: DataFrame, row_id: Column | None = None) -> DataFrame:
    """Text nulls become 'unknown', session ids are made from the row, session times from the event's."""
    if row_id is None:
        row_id = F.col("row_id") if "row_id" in df.columns else F.xxhash64(*df.columns)
    out = {c: F.coalesce(F.col(c), F.lit(UNKNOWN)) for c in TEXT_COLUMNS if c in df.columns}
    out["session_id"] = F.coalesce(first_truthy(F.col("session_id")), steady_id(row_id))
    out |= {c: F.coalesce(c, "timestamp") for c in ("session_start", "session_end")}
    return df.withColumns(out)


def drop_null_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys))


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """n rows without replacement, the same ones however the table is partitioned.

    A large sample is cut off by place in the order of the hash, so that no task gets all of it.
    """
    if n <= FEW:
        return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
    return placed(df.withColumn("__hash", F.xxhash64(key, F.lit(seed))), ["__hash", key], "__place").where(F.col("__place") <= n).drop("__hash", "__place")


def union(*frames: DataFrame) -> DataFrame:
    """All rows, columns matched by name; absent ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def unpermitted(df: DataFrame, permitted: DataFrame) -> DataFrame:
    """Rows whose (role, action) is not among the permitted ones."""
    return df.join(permitted.select("role", "action").distinct(), ["role", "action"], "left_anti")


def placed(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """df with its place, from 1, in the global order: a range sort, a count by partition and a running number.

    The sorted table is written, so that all rows keep the partition they were counted in.
    """
    # The id has the partition above its low 33 bits and the row's number in the partition in them.
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = rows.withColumns({"__part": F.shiftright("__id", 33).cast("int"), "__at": F.col("__id").bitwiseAND((1 << 33) - 1) + 1}).drop("__id")
    rows = materialize(rows, "placed")
    # One row a partition comes to the driver and goes back as the number of rows before it.
    sizes = sorted((r["__part"], r["count"]) for r in rows.groupBy("__part").count().collect())
    before = accumulate((n for _, n in sizes), initial=0)
    sizes = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "__of int, __before long")
    return rows.join(F.broadcast(sizes), F.col("__part") == F.col("__of")).withColumn(out, F.col("__before") + F.col("__at")).drop("__part", "__at", "__of", "__before")
