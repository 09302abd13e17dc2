"""Interaction audit of document filters: what each filter removes in every order of application.

A document matters only by the set of filters it fails, a mask of a few bits. So documents are
counted by part, mask and label, one row of counts for each part and label, and those rows are
multiplied by fixed 0/1 matrices that say for each mask what happens at each step of each order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import UPPER, materialize

#: Filters take 2 ** n masks and n! * n steps, so only a few can be audited together.
MOST_FILTERS = 6
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def outcome_matrices(n: int) -> dict[str, np.ndarray]:
    """kept, removed, redundant and unique: 2 ** n masks by n! * n steps, 1 where that is a mask's outcome.

    Bit i of a mask is a failure of filter i. Columns are the orders as itertools.permutations
    gives them, each with its n steps.
    """
    masks = np.arange(1 << n)[:, None]
    own, before = [], []
    for order in permutations(range(n)):
        for step, f in enumerate(order):
            own.append(1 << f)
            before.append(sum(1 << g for g in order[:step]))
    own, before = np.array(own), np.array(before)
    fails, gone = (masks & own) > 0, (masks & before) > 0
    return {
        "kept": (~fails & ~gone).astype(np.int64), "removed": (fails & ~gone).astype(np.int64),
        "redundant": (fails & gone).astype(np.int64), "unique": (masks == own).astype(np.int64),
    }


def steps_of(names: Sequence[str]) -> tuple[list[str], list[int], np.ndarray]:
    """The order, the step from 1 and the filter's number of each matrix column."""
    orders = list(permutations(range(len(names))))
    return (
        ["".join(names[f] for f in order) for order in orders for _ in order],
        [step for order in orders for step in range(1, len(order) + 1)],
        np.array([f for order in orders for f in order]),
    )


def outcomes(counts: np.ndarray, good: np.ndarray, toxic: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Results by part and step from counts by part and mask, of all documents and of both labels."""
    m = outcome_matrices(n)
    stacked = np.concatenate([counts, good, toxic]).astype(np.int64) @ m["removed"]
    removed, good_lost, toxic_lost = np.split(stacked, 3)
    of = steps_of([str(i) for i in range(n)])[2]
    shapley = np.zeros_like(removed)
    for f in range(n):
        shapley[:, of == f] = removed[:, of == f].sum(axis=1, keepdims=True)
    return {
        "kept": counts @ m["kept"], "removed": removed, "redundant": counts @ m["redundant"], "unique_fails": counts @ m["unique"],
        "good_lost": good_lost, "toxic_lost": toxic_lost, "shapley": shapley,
    }


def audit(flags: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per part, filter_order and step with the counts of COUNTS, zeros included.

    flags: part, mask (bit i: fails the filter names[i]), good, toxic, one row per document. Null
    parts are a part of their own; null masks and labels count as 0. Rows are counted as they
    come, repeated ones too; an empty table gives no rows. Every part is one group of at most
    2 ** n partial counts, however many rows it has.
    """
    n = len(names)
    if not 1 <= n <= MOST_FILTERS or len(set(names)) < n:
        raise ValueError(f"1 to {MOST_FILTERS} different filters")
    orders, numbers, _ = steps_of(names)
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in COUNTS]])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):  # parts at once
                batch = whole.slice(at, 64)
                rows = np.zeros((3, batch.num_rows, 1 << n), np.int64)
                for i, seen in enumerate(batch.column("seen").to_pylist()):
                    for x in seen:
                        rows[:, i, x["mask"]] = x["n"], x["good"], x["toxic"]
                found = outcomes(*rows, n)
                parts = [p for p in batch.column("part").to_pylist() for _ in orders]
                columns = [parts, orders * batch.num_rows, numbers * batch.num_rows, *[found[c].ravel() for c in COUNTS]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    counted = flags.groupBy("part", whole("mask").alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.sum(whole("good")).alias("good"), F.sum(whole("toxic")).alias("toxic"))
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("seen"))
    return by_part.mapInArrow(multiply, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: under 50 words; few distinct words; many capitals; odd characters. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # One kind of white space, so that the split needs no pattern.
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")

    def bits(w: Column) -> Column:
        capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
        fails = [F.size(w) < 50, 100 * F.size(F.array_distinct(w)) < 65 * F.size(w), 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
        out = F.lit(0)
        for i, f in enumerate(fails):
            out = out + F.when(f, 1 << i).otherwise(0)
        return out

    return F.transform(F.array(words), bits)[0]


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of five filters A to E over whole texts by part; E: identical to the text of a smaller id.

    Null and empty texts are equal; texts are compared by SHA-256. Null parts count as the empty
    string. Rows with a null id are nobody's copy and nobody's original. Repeated rows of one id
    and text are documents each, neither a copy of the other. A document is good, or toxic, if
    any row of labels says so. Other columns are ignored; very long texts are read whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_failures(F.col(text_col)).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
    )
    facts = materialize(facts, "audit-facts")
    # Joined by text and id, so that a text of very many copies is dealt by their ids.
    firsts = facts.where("id is not null").groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = facts.join(materialize(firsts, "audit-firsts"), ["key", "id"], "left").join(marked, "id", "left")
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    return audit(known.select("part", (F.col("mask") + copy).alias("mask"), "good", "toxic"), "ABCDE")
