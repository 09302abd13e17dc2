"""Large JSON log files, read by several tasks each.

A file is cut into blocks of bytes. What a block does to the brackets around it (how many it
closes, which it leaves open) only depends on whether it starts inside a string, so one pass
over all blocks finds both answers, these are chained along each file (one small row a block),
and a second pass reads the records that start in each block. A record that crosses into the
next block is read on by the task it starts in. No text is shuffled.

Files are uncompressed and opened by pyarrow.fs, so any file system that it knows will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.session import materialize

BLOCK = 32 << 20
#: Bytes before a bracket in which its key must lie.
BEHIND = 256
#: Most tasks of a pass, and records of one Arrow batch.
TASKS, ROWS = 100_000, 1000
#: The array whose elements are records, where the root is an object; it shows as R among open brackets.
KEY = b'"Records"'
QUOTE, ESCAPE = ord('"'), ord("\\")
_STEPS = np.zeros(256, np.int8)
_STEPS[[ord("{"), ord("[")]], _STEPS[[ord("}"), ord("]")]] = 1, -1
_MARKS = _STEPS != 0
_MARKS[[QUOTE, ESCAPE]] = True


def open_file(path: str) -> BinaryIO:
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    found, at = fs.FileSystem.from_uri(path)
    return found.open_input_file(at)


def border(f: BinaryIO, at: int, size: int) -> int:
    """The first place from `at` on that doesn't follow a backslash: no escape is cut in two."""
    while 0 < at < size:
        f.seek(at - 1)
        piece = f.read(BEHIND)
        rest = len(piece) - len(piece.lstrip(b"\\"))
        at += rest
        if rest < len(piece):
            break
    return min(at, size)


def marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, kinds, quotes that start or end a string before or at each) of brackets, quotes and backslashes."""
    buf = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_MARKS[buf])
    kind = buf[at]
    # A quote after an odd run of backslashes belongs to the string.
    n, slash = np.arange(len(at)), kind == ESCAPE
    goes_on = np.concatenate([[False], slash[1:] & slash[:-1] & (at[1:] == at[:-1] + 1)])[: len(at)]
    odd = slash & ((n - np.maximum.accumulate(np.where(goes_on, 0, n))) % 2 == 0)
    escaped = np.concatenate([[False], odd[:-1] & (at[1:] == at[:-1] + 1)])[: len(at)]
    return at, kind, np.cumsum((kind == QUOTE) & ~escaped)


def brackets(found: tuple[np.ndarray, np.ndarray, np.ndarray], in_string: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places, steps, whether the data end inside a string): brackets outside of strings, 1 opens and -1 closes."""
    at, kind, quotes = found
    inside = (quotes + in_string) % 2 == 1
    steps = np.where(inside, 0, _STEPS[kind])
    kept = steps != 0
    return at[kept], steps[kept], bool(inside[-1]) if len(at) else in_string


def _symbol(head: bytes, data: bytes, at: int) -> str:
    """The bracket at a place of data, R for the array of records; head is what comes before data."""
    symbol = chr(data[at])
    if symbol == "[":
        before = (head + data[:at] if at < BEHIND else data[at - BEHIND : at]).rstrip()
        if before.endswith(b":") and before[:-1].rstrip().endswith(KEY):
            return "R"
    return symbol


def summary(head: bytes, data: bytes, found: tuple[np.ndarray, np.ndarray, np.ndarray], in_string: bool) -> tuple[bool, int, str]:
    """(ends inside a string, brackets of earlier blocks that it closes, brackets that it leaves open)."""
    at, steps, ends_inside = brackets(found, in_string)
    if not len(at):
        return ends_inside, 0, ""
    depth = np.cumsum(steps, dtype=np.int64)
    low = min(0, int(depth.min()))
    opened = steps > 0
    left = [int(np.flatnonzero(opened & (depth == level))[-1]) for level in range(low + 1, int(depth[-1]) + 1)]
    return ends_inside, -low, "".join(_symbol(head, data, int(at[i])) for i in left)


def chain(blocks: pd.DataFrame) -> pd.DataFrame:
    """What is open where each block of one file starts, from the blocks' summaries."""
    inside, stack, states = False, "", []
    blocks = blocks.sort_values("start")
    for row in blocks.itertuples():
        states.append((inside, stack))
        ends, pops, opens = (row.in_ends, row.in_pops, row.in_opens) if inside else (row.out_ends, row.out_pops, row.out_opens)
        inside, stack = bool(ends), stack[: max(0, len(stack) - pops)] + opens
    return pd.DataFrame({"path": blocks["path"], "length": blocks["length"], "start": blocks["start"], "inside": [s[0] for s in states], "stack": [s[1] for s in states]})


def _complete(f: BinaryIO, start: int, size: int) -> bytes | None:
    """The record at `start`, however long; None if the file ends in it. Each look is twice as long as the one before."""
    look = 1 << 16
    while True:
        f.seek(start)
        data = f.read(look)
        at, steps, _ = brackets(marks(data), False)
        closed = np.flatnonzero(np.cumsum(steps, dtype=np.int64) == 0)
        if len(closed):
            return data[: int(at[closed[0]]) + 1]
        if start + look >= size:
            return None
        look *= 2


def records_in(f: BinaryIO, size: int, start: int, block: int, in_string: bool, stack: str) -> Iterator[bytes]:
    """The records that start in a block: objects in a root array, or in the Records of a root object."""
    first, end = border(f, start, size), border(f, start + block, size)
    head_at = max(0, first - BEHIND)
    f.seek(head_at)
    data = f.read(end - head_at)
    head, data = data[: first - head_at], data[first - head_at :]
    at, steps, _ = brackets(marks(data), in_string)
    depth = len(stack) + np.cumsum(steps, dtype=np.int64)
    opened = steps > 0

    def around(level: int, places: np.ndarray) -> np.ndarray:
        """The bracket open at a level where each of these brackets stands."""
        found = np.flatnonzero(opened & (depth == level))
        last, of = np.unique(np.searchsorted(found, places) - 1, return_inverse=True)
        before = stack[level - 1] if len(stack) >= level else ""
        return np.array([before if k < 0 else _symbol(head, data, int(at[found[k]])) for k in last], dtype="<U1")[of]

    objects = opened & (np.frombuffer(data, np.uint8)[at] == ord("{"))
    second, third = np.flatnonzero(objects & (depth == 2)), np.flatnonzero(objects & (depth == 3))
    bare = second[around(1, second) == "["]
    wrapped = third[around(1, third) == "{"]
    wrapped = wrapped[around(2, wrapped) == "R"]
    for records, level in ((bare, 2), (wrapped, 3)):
        closings = np.flatnonzero(~opened & (depth == level - 1))
        ends = np.searchsorted(closings, records)
        done = ends < len(closings)
        for a, b in zip(at[records[done]].tolist(), at[closings[ends[done]]].tolist(), strict=True):
            yield data[a : b + 1]
        # At most one record goes on in the next block.
        for a in at[records[~done]].tolist():
            if (record := _complete(f, first + a, size)) is not None:
                yield record


def record_texts(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(record string) of all JSON files of a path. Cut-off records and elements that aren't objects are left out."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    tasks = files.agg(F.sum(F.ceil(F.col("length") / block))).first()[0] or 1
    tasks = int(min(max(tasks, 1), TASKS))
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(block))).alias("start"))

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                with open_file(row.path) as f:
                    first, end = border(f, row.start, row.length), border(f, row.start + block, row.length)
                    head_at = max(0, first - BEHIND)
                    f.seek(head_at)
                    data = f.read(end - head_at)
                head, data = data[: first - head_at], data[first - head_at :]
                found = marks(data)
                out.append((row.path, row.length, row.start, *summary(head, data, found, False), *summary(head, data, found, True)))
            yield pd.DataFrame(out, columns=["path", "length", "start", "out_ends", "out_pops", "out_opens", "in_ends", "in_pops", "in_opens"])

    ends = "out_ends boolean, out_pops long, out_opens string, in_ends boolean, in_pops long, in_opens string"
    found = blocks.repartition(tasks).mapInPandas(summaries, f"path string, length long, start long, {ends}")
    states = materialize(found.groupBy("path").applyInPandas(chain, "path string, length long, start long, inside boolean, stack string"), "json-blocks")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = []
                with open_file(row["path"]) as f:
                    for record in records_in(f, row["length"], row["start"], block, row["inside"], row["stack"]):
                        held.append(record)
                        if len(held) == ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                            held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    return states.repartition(tasks).mapInArrow(texts, "record binary").select(F.col("record").cast("string").alias("record"))


def parsed(texts: DataFrame, record: str) -> DataFrame:
    """The fields of a record schema; text that isn't JSON is left out, fields of other types are null."""
    fields = record[record.index("<") + 1 : -1]
    read = F.from_json("record", f"{fields}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = texts.select("record", read.alias("r"))
    return rows.where("r._corrupt_record is null or try_parse_json(record) is not null").select("r.*").drop("_corrupt_record")
