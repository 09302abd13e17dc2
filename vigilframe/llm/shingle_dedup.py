"""The exact similarity of shingle sets behind near-duplicates at a similarity.

SimHash finds the closest copies; texts at a similarity of 0.8 differ in ten of its 64 bits on
average, beyond any budget that keeps a trie small. So bands of a MinHash signature lead together
what the trie leaves apart. Every link is confirmed on the whole sets. In a bucket, classes meet
one centre at a time, so that a large group of near copies is joined without its pairs; what
stays apart after that is compared in blocks inside tasks, which return a forest of the links
they find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm import textnum
from vigilframe.llm.common import discard, materialize, row_hash
from vigilframe.llm.components import connected_components, forest
from vigilframe.llm.simhash import AT_ONCE, fingerprint_links, majority

#: A pair at a similarity of 0.8 shares none of the bands with probability 1.1e-4; closer pairs less.
BANDS, ROWS = 30, 6
#: A bucket of more classes than this, not all linked, meets further centres, in so many rounds, before it is compared in blocks.
LARGE, ROUNDS = 20_000, 3
#: Sets and bytes of sets in one part of a bucket; columns of a block's table at once.
PART, PART_BYTES, COLUMNS = 512, 16 << 20, 8192
_draw = np.random.default_rng(20240301)
_TIMES = _draw.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 2**63, BANDS * ROWS, np.uint64)


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat, k = b" ".join(words), max(1, len(words) - n + 1)
    if k == 1:
        return np.array([xxhash.xxh64_intdigest(flat, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:k]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(flat[s:e], 42) for s, e in zip(starts.tolist(), (ends[n - 1 :] - 1).tolist(), strict=True)), np.uint64, k))


def bands(h: np.ndarray) -> np.ndarray:
    """One key for each band of the MinHash signature of a set."""
    low = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for i in range(0, len(h), 1024):
        low = np.minimum(low, (h[i : i + 1024, None] * _TIMES + _PLUS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = textnum.pair(key, column)
    return key


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def similar_pairs(sets: list[np.ndarray], cut: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of similar sets: of all pairs if cut is 0, else with i before cut and j from there on."""
    left, right = (sets, sets) if not cut else (sets[:cut], sets[cut:])
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    owner, column = owner[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[owner[i:j], column[i:j] - at] = 1
        both += table[: len(left)] @ table[-len(right) :].T
    joint = size[: len(left), None] + size[None, -len(right) :] - both
    i, j = np.nonzero(both >= similarity * joint)
    if not cut:
        i, j = i[j > i], j[j > i]
    # The table's counts are whole numbers below 2^24; larger sets are counted again.
    sure = np.array([both[p, q] < 2**23 or similarity_of(left[p], right[q]) >= similarity for p, q in zip(i, j, strict=True)], bool)
    return i[sure], j[sure] + cut


def _signed(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, cls, fp, bands): row is a hash of id and text, cls one of the shingle set, fp its SimHash."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, fps, keys = [], [], []
            for i in range(0, batch.num_rows, AT_ONCE):
                for t in batch.column("body").slice(i, AT_ONCE).to_pylist():
                    h = shingles(t, shingle)
                    cls.append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                    fps.append(majority(h))
                    keys.append(bands(h).view(np.int64) if len(h) else np.empty(0, np.int64))
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), longs(cls), longs(fps), pa.array(keys, pa.list_(pa.int64()))], names=["id", "row", "cls", "fp", "bands"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), row_hash(id_col, text_col).alias("row"), F.col(text_col).cast("binary").alias("body"))
    return source.mapInArrow(hashed, "id long, row long, cls long, fp long, bands array<long>")


def _sets(docs: DataFrame, named: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(cls, shingles): the whole set of each class of named (cls, id, row)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(i, AT_ONCE)
                yield pa.RecordBatch.from_arrays([some.column("cls"), pa.array([shingles(t, shingle).astype("<u8").tobytes() for t in some.column("body").to_pylist()], pa.binary())], names=["cls", "shingles"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), row_hash(id_col, text_col).alias("row"), F.col(text_col).cast("binary").alias("body"))
    named = named.withColumnsRenamed({"id": "named_id", "row": "named_row"})
    found = source.join(named, source["id"].eqNullSafe(named["named_id"]) & (source["row"] == named["named_row"])).select("cls", "body")
    return found.mapInArrow(cut, "cls long, shingles binary").dropDuplicates(["cls"])


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) of classes whose shingle sets are similar."""

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = [similarity_of(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) >= similarity for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            yield pdf.loc[np.array(near, bool), ["src", "dst"]]

    left, right = sets.select(F.col("cls").alias("src"), F.col("shingles").alias("a")), sets.select(F.col("cls").alias("dst"), F.col("shingles").alias("b"))
    return materialize(pairs.join(left, "src").join(right, "dst").select("src", "dst", "a", "b").mapInPandas(compared, "src long, dst long"), "near-links")


def _ends(a: str, b: str) -> tuple:
    return F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")


def _fingerprint_pairs(rows: DataFrame, budget: int) -> DataFrame:
    """Pairs of classes by the trie: those of one fingerprint meet one of them, linked fingerprints meet by theirs."""
    classes = rows.where(F.size("bands") > 0).select("fp", "cls").distinct()
    heads = materialize(classes.groupBy("fp").agg(F.min("cls").alias("one")), "near-heads")
    links = fingerprint_links(heads.select("fp"), budget)
    same = classes.join(heads, "fp").where("cls <> one").select(*_ends("cls", "one"))
    src, dst = heads.select(F.col("fp").alias("src"), F.col("one").alias("a")), heads.select(F.col("fp").alias("dst"), F.col("one").alias("b"))
    return same.union(links.join(src, "src").join(dst, "dst").select(*_ends("a", "b"))).distinct()


def _blocks(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): a forest of the links in each bucket of (key, cls), every two parts of a bucket meeting once."""
    per = apart.join(sets.select("cls", F.length("shingles").alias("width")), "cls").groupBy("key")
    sizes = per.agg(F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum("width") / PART_BYTES)).alias("parts"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("xor"))
    # Buckets of the same classes do the same work: one of them is enough.
    sizes = materialize(sizes.groupBy("sum", "xor", "parts").agg(F.min("key").alias("key")).select("key", "parts"), "near-sizes")
    dealt = apart.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls").join(sets, "cls")

    def compared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("own", kind="stable")
        cut = int((pdf["own"] == key[1]).sum()) if key[1] != key[2] else 0
        if len(pdf) < 2 or cut == len(pdf) or (key[1] != key[2] and not cut):
            return pd.DataFrame({"src": [], "dst": []})
        i, j = similar_pairs([np.frombuffer(x, "<u8") for x in pdf["shingles"]], cut, similarity)
        cls = pdf["cls"].to_numpy(np.int64)
        a, b = forest(cls[i], cls[j])
        return pd.DataFrame({"src": a, "dst": b})

    return materialize(dealt.groupBy("key", "i", "j").applyInPandas(compared, "src long, dst long"), "near-links")


def similar_rows(docs: DataFrame, shingle: int, similarity: float, budget: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, label): rows whose shingle sets are linked, directly or by others, share a label."""
    rows = materialize(_signed(docs, shingle, id_col, text_col), "near-signed")
    buckets = rows.where(F.size("bands") > 0).groupBy("cls").agg(F.first("bands").alias("bands")).select("cls", F.explode("bands").alias("key"))
    full = materialize(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "near-keys")
    members = materialize(buckets.join(full, "key"), "near-buckets")
    pairs = materialize(_fingerprint_pairs(rows, budget), "near-pairs")
    # Written before the joins on cls: many rows may be copies of one class.
    wanted = materialize(members.select("cls").union(pairs.select("src")).union(pairs.select("dst")).distinct(), "near-wanted")
    named = rows.join(wanted, "cls").groupBy("cls").agg(F.min(F.struct("id", "row")).alias("r")).select("cls", "r.*")
    sets = materialize(_sets(docs, named, shingle, id_col, text_col), "near-sets")

    def starred(parts: DataFrame, turn: int) -> DataFrame:
        """Pairs of each class with one class of its bucket that lies in another part."""
        centre = F.min_by(F.struct(F.col("cls").alias("one"), F.col("part").alias("at")), F.xxhash64("cls", "key", F.lit(turn)))
        centres = materialize(parts.groupBy("key").agg(centre.alias("c")).select("key", "c.*"), "near-centres")
        return materialize(parts.join(centres, "key").where("part <> at").select(*_ends("cls", "one")).distinct(), "near-pairs")

    links = _confirmed(pairs.union(starred(members.withColumn("part", F.col("cls")), 0)).distinct(), sets, similarity)
    turn, large = 0, True
    while large:
        # (key, cls, part) of the buckets whose classes lie in several parts.
        labels = materialize(connected_components(links).withColumnRenamed("node", "cls"), "near-labels")
        parts = members.join(labels, "cls", "left").select("key", "cls", F.coalesce("label", "cls").alias("part"))
        split = parts.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
        split = materialize(split.select("key", "n"), "near-split")
        parts = materialize(parts.join(split.select("key"), "key"), "near-parts")
        turn += 1
        large = turn < ROUNDS and not split.where(F.col("n") > LARGE).isEmpty()
        if large:
            links = links.union(_confirmed(starred(parts, turn), sets, similarity))
    more = _blocks(parts.select("key", "cls"), sets, similarity)
    if not more.isEmpty():
        # Labels are smaller than links, so the rest is linked by them.
        label = lambda end: labels.select(F.col("cls").alias(end), F.col("label").alias(f"{end}_label"))
        named = more.join(label("src"), "src", "left").join(label("dst"), "dst", "left").select(F.coalesce("src_label", "src").alias("src"), F.coalesce("dst_label", "dst").alias("dst"))
        above = connected_components(named).select(F.col("node").alias("label"), F.col("label").alias("top"))
        lone = above.select(F.col("label").alias("cls"), "label")  # classes that had no label yet
        labels = labels.union(lone).dropDuplicates(["cls"]).join(above, "label", "left").select("cls", F.coalesce("top", "label").alias("label"))
    labels = materialize(labels, "near-labels")
    out = materialize(rows.select("id", "row", "cls").join(labels, "cls", "left").select("id", "row", F.coalesce("label", "cls").alias("label")), "near-rows")
    discard(rows, full, members, pairs, sets, parts)
    return out
