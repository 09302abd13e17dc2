"""SimHash near-dedup with a binary-trie self-join.

Fingerprints that differ in at most k bits agree in at least one of k + 1 blocks of bits, so each
fingerprint is dealt once per block and only meets those that share the block. In a task these
form a binary trie over the other bits: node pairs are walked together, differing bits add up,
and a pair that exceeds the budget is cut. A task returns a spanning forest of the links it
finds, never the pairs of a group; components then come from the forests of all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.common import materialize, row_hash
from vigilframe.llm.components import connected_components, forest

BITS = 64
#: Node pairs no larger than this are compared leaf by leaf.
LEAF_PAIRS = 256
#: Node pairs and leaf comparisons worked on at once; a bound on memory, not on results.
FRONTIER, EXPAND, AT_ONCE = 1 << 15, 1 << 18, 256


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of a text: words lower-cased in A-Z, shingles hashed by XXH64 with seed 42."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat, n = b" ".join(words), len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(flat, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(flat[s:e], 42) for s, e in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    return majority(h)


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, fp): row is a hash of id and text, fp the 64 bits as a signed long.

    Null text has fingerprint zero.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.empty(batch.num_rows, np.uint64)
            for i in range(0, batch.num_rows, AT_ONCE):  # a few texts at a time become Python objects
                fp[i : i + AT_ONCE] = [fingerprint(t, shingle) for t in batch.column("body").slice(i, AT_ONCE).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(fp.view(np.int64))], names=["id", "row", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), row_hash(id_col, text_col).alias("row"), F.col(text_col).cast("binary").alias("body"))
    return source.mapInArrow(hashed, "id long, row long, fp long")


def _ranges(lo: np.ndarray, hi: np.ndarray, code: np.ndarray, bit: int) -> np.ndarray:
    """First index in each [lo, hi) whose code has the bit; all its higher bits agree there."""
    one = np.uint64(1) << np.uint64(bit)
    first = (code[lo] >> np.uint64(bit + 1) << np.uint64(bit + 1)) | one
    return np.clip(np.searchsorted(code, first), lo, hi)


def trie_join(code: np.ndarray, top_bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs, of the links among codes that agree in their top bits.

    code: sorted distinct uint64. Links differ in at most budget bits.
    """
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    pending = 0

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal out_a, out_b, pending
        out_a.append(a)
        out_b.append(b)
        pending += len(a)
        if pending > 2 * EXPAND:
            a, b = forest(np.concatenate(out_a), np.concatenate(out_b))
            out_a, out_b, pending = [a], [b], 0

    def compare(a: np.ndarray) -> None:
        """Leaf by leaf: rows of (lo, hi, lo, hi, differing bits so far)."""
        size = (a[:, 1] - a[:, 0]) * (a[:, 3] - a[:, 2])
        upto = np.cumsum(size)
        at = 0
        while at < len(a):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + EXPAND)))
            part, n = a[at:end], size[at:end]
            row = np.repeat(np.arange(len(part)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            width = (part[:, 3] - part[:, 2])[row]
            i, j = part[row, 0] + k // width, part[row, 2] + k % width
            ok = (i != j) & (np.bitwise_count(code[i] ^ code[j]) <= budget)
            keep(i[ok], j[ok])
            at = end

    shift = np.uint64(BITS - top_bits)
    top = code >> shift
    starts = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])) if len(code) else np.empty(0, np.int64)
    ends = np.concatenate([starts[1:], [len(code)]]) if len(code) else starts
    many = ends - starts > 1
    first = np.stack([starts, ends, starts, ends, np.zeros_like(starts)], axis=1)[many]
    stack = [(BITS - top_bits - 1, first[i : i + FRONTIER]) for i in range(0, len(first), FRONTIER)]
    while stack:
        bit, pairs = stack.pop()
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAF_PAIRS
        if bit < 0:
            small[:] = True
        if small.any():
            compare(pairs[small])
        pairs = pairs[~small]
        if not len(pairs):
            continue
        a0, a1, b0, b1, d = pairs.T
        am, bm = _ranges(a0, a1, code, bit), _ranges(b0, b1, code, bit)
        same = a0 == b0
        children = [
            np.stack([a0, am, b0, bm, d], axis=1), np.stack([am, a1, bm, b1, d], axis=1),
            np.stack([a0, am, bm, b1, d + 1], axis=1), np.stack([am, a1, b0, bm, d + 1], axis=1)[~same],
        ]
        nxt = np.concatenate(children)
        nxt = nxt[(nxt[:, 0] < nxt[:, 1]) & (nxt[:, 2] < nxt[:, 3]) & (nxt[:, 4] <= budget)]
        stack += [(bit - 1, nxt[i : i + FRONTIER]) for i in range(0, len(nxt), FRONTIER)]
    return forest(np.concatenate(out_a), np.concatenate(out_b))


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(BITS - by))


def fingerprint_links(fps: DataFrame, budget: int) -> DataFrame:
    """(src, dst): edges that connect distinct fingerprints (fp) of at most budget differing bits."""
    blocks = budget + 1
    cuts = [round(BITS * i / blocks) for i in range(blocks + 1)]
    routes = F.array(*[
        F.struct(F.lit(r).alias("route"), F.shiftrightunsigned(F.shiftleft("fp", cuts[r]), BITS - cuts[r + 1] + cuts[r]).alias("part"))
        for r in range(blocks)
    ])
    dealt = fps.select("fp", F.explode(routes).alias("x")).select("fp", "x.route", "x.part").repartition("route", "part")

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [(p["route"].to_numpy(np.int64), p["fp"].to_numpy(np.int64).view(np.uint64)) for p in batches if len(p)]
        if not got:
            return
        route, fp = (np.concatenate(x) for x in zip(*got, strict=True))
        for r in np.unique(route):
            code = np.unique(_rotate(fp[route == r], cuts[r]))
            a, b = trie_join(code, cuts[r + 1] - cuts[r], budget)
            back = _rotate(code, BITS - cuts[r]) if cuts[r] else code
            yield pd.DataFrame({"src": back[a].view(np.int64), "dst": back[b].view(np.int64)})

    return dealt.mapInPandas(joined, "src long, dst long")


def _grouped(docs: DataFrame, shingle: int, budget: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, fp, label, component_id) for each row; label names the component."""
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    labels = connected_components(fingerprint_links(rows.select("fp").distinct(), budget)).withColumnRenamed("node", "fp")
    labels = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")).join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "simhash-labels")
    named = labels.join(labels.groupBy("label").agg(F.min("low").alias("component_id")), "label").select("fp", "label", "component_id")
    return rows.join(named, "fp")


def simhash_groups(docs: DataFrame, shingle: int = 5, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Rows link when their fingerprints differ in at most budget bits; component_id is the smallest
    id reachable. Texts without words, null included, have fingerprint zero and link like others.
    Very long texts are hashed whole. Repeated rows share a component. A null id gets the
    component's smallest other id, or null. An empty table gives no rows. Other columns are
    ignored.
    """
    return _grouped(docs, shingle, budget, id_col, text_col).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 5, budget: int = 3, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """docs, all columns, with one row of each group: that of the smallest id, null ids last.

    Rows link when their fingerprints differ in at most budget bits. With similarity, they link
    when the Jaccard similarity of their shingle sets is at least that: the trie's links are
    confirmed on the whole sets, and bands of the sets find the pairs that 64 bits leave beyond
    the budget. Texts without words are one group. Very long texts are compared whole. Of rows
    that agree in id and text one stays. An empty table gives no rows. Columns of any name pass
    through, save names that start with "__near".
    """
    if similarity is not None:
        from vigilframe.llm.shingle_dedup import similar_rows

        return keep_one(docs, similar_rows(docs, shingle, similarity, budget, id_col, text_col), id_col, text_col)
    return keep_one(docs, materialize(_grouped(docs, shingle, budget, id_col, text_col).select("id", "row", "label"), "near-rows"), id_col, text_col)


def keep_one(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each label of (id, row, label): that of the smallest id, null ids last."""
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    stays = materialize(rows.groupBy("label").agg(F.min(place).alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1").select("label", "stays"), "near-stays")
    gone = rows.join(stays, "label").where(place != F.col("stays")).select(F.col("id").alias("__near_of"), F.col("row").alias("__near_hash")).distinct()
    keyed = docs.withColumns({"__near_id": F.col(id_col).cast("long"), "__near_row": row_hash(id_col, text_col)})
    same = keyed["__near_id"].eqNullSafe(F.col("__near_of")) & (keyed["__near_row"] == F.col("__near_hash"))
    left = keyed.join(gone, same, "left_anti")
    repeats = materialize(rows.groupBy("id", "row").count().where("count > 1").select(F.col("id").alias("__near_of"), F.col("row").alias("__near_hash")), "near-repeats")
    if not repeats.isEmpty():
        nth = F.row_number().over(Window.partitionBy("__near_id", "__near_row").orderBy(F.lit(1)))
        one = left.join(repeats, same, "left_semi").withColumn("__near_nth", nth).where("__near_nth = 1").drop("__near_nth")
        left = left.join(repeats, same, "left_anti").unionByName(one)
    return left.select(*[f"`{c}`" for c in docs.columns])
