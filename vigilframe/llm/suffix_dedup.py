"""Removal of long repeated strings by prefix doubling over anchored positions.

Prefix doubling sorts pairs of a position's rank so far and the rank of what follows it, at
growing offsets, and gives new ranks until they are unique or long enough. Over all bytes that
sends every byte of the corpus through a shuffle in each round. So the positions here are
anchors: of every `length` consecutive bytes, the place of the string of half that length with
the smallest hash. Equal strings have equal anchors at equal places, so a string can only repeat
where its anchor's does, and few positions go into the first round.

A round sorts (rank, name of the bytes by which the string grew) and gives equal pairs a new
rank; unique ones are dropped. Strings around an anchor grow to both sides: a position stands for
a range of starts before the anchor, `inner` is what all strings with such starts share, `outer`
what they cover together. If an outer is repeated so are all of them; otherwise the range is cut
into smaller ones with longer inners, until a range is one start and its inner the string itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm import common
from vigilframe.llm.common import discard

#: Starts that are hashed at once, rows that are sent at once, and parts into which a range of starts is cut: bounds on memory and rounds.
BLOCK, ROWS, PARTS = 1 << 18, 20_000, 8
#: Odd numbers: multiplier of the rolling hash and of its mixing.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
PLACE = np.uint64((1 << 20) - 1)

NODE = "kid long, row long, at int, first int, last int, lo int, hi int, rank long, certain boolean, ext long, x long, y long"
NODE_COLUMNS = ("kid", "row", "at", "first", "last", "lo", "hi", "rank", "certain", "ext", "x", "y")
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _written(df: DataFrame, tag: str) -> DataFrame:
    """Each round writes small tables in many files; their compressors would take more memory than they save disk."""
    return common.materialize(df, f"suffix-{tag}", compression="uncompressed")


def _batch(ddl: str, columns: list) -> pa.RecordBatch:
    fields = [f.split(" ") for f in ddl.split(", ")]
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in fields])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns or [[]] * len(fields), schema, strict=True)], schema=schema)


def anchors(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(at, first, last, name): the anchors of a text and the starts of the strings they stand for.

    The anchor of the string at p is the place in p to p + length - gram of the gram whose hash
    is the smallest, the leftmost of equal ones, so it depends on the string alone.
    """
    gram = length // 2
    span = length - gram + 1  # grams in a string
    if length not in _powers:
        n = BLOCK + length
        _powers[length] = tuple(np.cumprod(np.full(n, x & (2**64 - 1), np.uint64)) for x in (BASE, pow(BASE, -1, 2**64)))
    up, down = _powers[length]
    at, first, name = [], [], []
    starts = len(b) - length + 1
    for begin in range(0, starts, BLOCK):
        some = b[begin : min(begin + BLOCK, starts) + length - 1].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(some * up[: len(some)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[: len(some) - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        h ^= h >> np.uint64(32)
        least, size = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * size <= span:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < span:
            least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
        picked = (least & PLACE).astype(np.int64)
        new = np.flatnonzero(np.r_[True, picked[1:] != picked[:-1]])
        if at and at[-1][-1] == picked[0] + begin:
            new = new[1:]
        at.append(picked[new] + begin)
        first.append(new + begin)
        name.append(h[picked[new]].view(np.int64))
        if not len(new):
            at.pop(), first.pop(), name.pop()
    at, first, name = map(np.concatenate, (at, first, name))
    return at, first, np.r_[first[1:] - 1, starts - 1], name


def _digest(text: bytes, before: int, after: int) -> tuple[int, int]:
    """128 bits of a string and of how far its starts lie before an anchor."""
    whole = xxhash.xxh3_128_intdigest(text, seed=before << 32 | after)
    return (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)


def _positions(docs: DataFrame, length: int) -> DataFrame:
    """NODE rows, one for each anchor: all its starts, named by its gram."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_buffer()
                if not text or text.size < length:
                    continue
                kid, row, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), memoryview(text)
                for at, first, last, name in zip(*(x.tolist() for x in anchors(np.frombuffer(text, np.uint8), length)), strict=True):
                    rows.append((kid, row, at, first, last, 0, length - length // 2, 0, False, name, *_digest(data[first : last + length], at - first, at - last)))
                    if len(rows) >= ROWS:
                        yield _batch(NODE, list(zip(*rows, strict=True)))
                        rows = []
        yield _batch(NODE, list(zip(*rows, strict=True)))

    return docs.select("kid", "row", "text").mapInArrow(scan, NODE)


def _contexts(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """(kid, row, at, context): the bytes that strings around the anchors cover."""
    wanted = open_.groupBy("kid", "row").agg(F.collect_set(F.struct("at", "first", "last")).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ddl, rows = "kid long, row long, at int, context binary", []
        for batch in batches:
            for i in range(batch.num_rows):
                kid, row, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), memoryview(batch.column(2)[i].as_buffer())
                for x in batch.column(3)[i].as_py():
                    rows.append((kid, row, x["at"], bytes(text[x["first"] : x["last"] + length])))
                    if len(rows) >= ROWS:
                        yield _batch(ddl, list(zip(*rows, strict=True)))
                        rows = []
        yield _batch(ddl, list(zip(*rows, strict=True)))

    found = docs.join(wanted, ["kid", "row"]).select("kid", "row", "text", "places").mapInArrow(cut, "kid long, row long, at int, context binary")
    return found.dropDuplicates(["kid", "row", "at"])


def _grown(open_: DataFrame, contexts: DataFrame, length: int, width: int) -> DataFrame:
    """NODE rows: each range of starts cut into ranges of `width`, named by what their inner has more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for kid, row, at, first, last, lo, hi, rank, certain, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for low in range(lo, hi + 1, width):
                    high = min(low + width - 1, hi)
                    start, end = max(at - high, first), min(at - low, last)
                    if start > end:
                        continue
                    # Of the range's inner, [at - low, at - high + length), what the inner of the range it is cut from doesn't have.
                    more = context[at - low - first : at - lo - first] + b"|" + context[at - hi + length - first : at - high + length - first]
                    ext = xxhash.xxh3_64_intdigest(more) - (1 << 63)
                    rows.append((kid, row, at, first, last, low, high, rank, certain, ext, *_digest(context[start - first : end + length - first], at - start, at - end)))
                if len(rows) >= ROWS:
                    yield _batch(NODE, list(zip(*rows, strict=True)))
                    rows = []
        yield _batch(NODE, list(zip(*rows, strict=True)))

    joined = open_.join(contexts, ["kid", "row", "at"]).select("kid", "row", "at", "first", "last", "lo", "hi", "rank", "certain", "context")
    return joined.mapInArrow(cut, NODE)


def _rerank(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks, open): ranges of starts whose strings are repeated, and what has to grow further.

    Of nodes that agree in their outers one goes on, certain already, as what others may equal.
    """
    pair = ["rank", "lo", "ext"]
    differ = (F.min("x") != F.max("x")) | (F.min("y") != F.max("y"))
    repeated = nodes.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), differ.alias("mixed")).where("n > 1")
    # New ranks follow the order of the pairs. Written, so that ranks don't change and a common pair can be split in the join.
    ranks = _written(repeated.orderBy(*pair).select(*pair, F.monotonically_increasing_id().alias("new"), "mixed"), "ranks")
    kept = _written(nodes.join(ranks, pair).withColumn("place", F.xxhash64("kid", "row", "at")).drop(*[c for c in pair if c != "lo"]).withColumnRenamed("new", "rank"), "kept")
    same = ["rank", "x", "y"]
    groups = kept.where("mixed").groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("one"), F.max("certain").alias("known"))
    groups = _written(groups.withColumn("known", F.col("known") | (F.col("n") > 1)), "groups")
    # Written too, so that a rank with very many outers can be split in the join.
    growing = _written(groups.groupBy("rank").agg(F.min("known").alias("settled")), "growing")
    outers = _written(groups.join(growing, "rank"), "outers")
    mixed = kept.where("mixed").join(outers, same)
    outer = F.struct("kid", "row", F.greatest(F.col("at") - F.col("hi"), "first").alias("start"), F.least(F.col("at") - F.col("lo"), "last").alias("end"))
    marks = kept.where("not mixed and not certain").select(outer.alias("m")).unionByName(mixed.where("n > 1 and not certain").select(outer.alias("m"))).select("m.*")
    rest = mixed.where("not settled and place = one and lo < hi").select("kid", "row", "at", "first", "last", "lo", "hi", "rank", F.col("known").alias("certain"))
    marks, rest = _written(marks, "marks"), _written(rest, "open")
    discard(ranks, kept, groups, growing, outers)
    return marks, rest


def repeated_strings(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, spans array<struct<start, end>>, kept binary.

    A span is a maximal run of bytes covered by strings of `length` bytes that start anywhere
    else too, in any document or at another place of the same one; kept are the bytes outside
    all spans, in order, which need not be valid UTF-8. Strings never reach over documents. Null
    texts are empty; texts shorter than length have no spans; repeated rows repeat each other;
    null ids are ids like others; an empty table gives no rows; other columns are ignored.
    Texts of any length up to 2 GB are read whole.

    Strings count as equal by 128 bits of hash.
    """
    if not 4 <= length <= 1 << 19:
        raise ValueError("a length from 4 to 524,288 bytes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("kid"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row"), text.cast("binary").alias("text"))
    nodes, contexts, all_marks = _written(_positions(keyed, length), "positions"), None, []
    width = length - length // 2 + 1
    while True:
        marks, open_ = _rerank(nodes)
        all_marks.append(marks)
        discard(nodes)
        if width == 1 or open_.isEmpty():
            break
        if contexts is None:
            contexts = _written(_contexts(keyed, open_, length), "contexts")
        width = -(-width // PARTS)
        nodes = _written(_grown(open_, contexts, length, width), "nodes")
    if contexts is not None:
        discard(contexts)
    marked = all_marks[0]
    for m in all_marks[1:]:
        marked = marked.unionByName(m)
    marked = marked.groupBy("kid", "row").agg(F.collect_set(F.struct("start", F.col("end"))).alias("marks"))
    ddl = "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                spans: list[dict] = []
                for start, end in sorted((m["start"], m["end"] + length) for m in batch.column(2)[i].as_py() or ()):
                    if spans and start <= spans[-1]["end"]:
                        spans[-1]["end"] = max(end, spans[-1]["end"])
                    else:
                        spans.append({"start": start, "end": end})
                cuts = [0, *[x for s in spans for x in (s["start"], s["end"])], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)) if spans else text
                rows.append((batch.column(0)[i].as_py(), len(text), spans, kept))
                size += len(kept)
                if size > 1 << 23 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0

    found = keyed.join(marked, ["kid", "row"], "left").select("id", "text", "marks")
    return found.mapInArrow(remove, ddl).withColumnRenamed("id", id_col)
