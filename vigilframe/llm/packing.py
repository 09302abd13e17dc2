"""Packing of tokenised documents into fixed windows by minimum bin slack.

Each document becomes whole windows and one rest. A histogram of piece lengths, at most as long
as the window, is all that planning needs: a bitset subset-sum finds the lengths that fill a
window best, the counts are traced back, and that pattern repeats while its lengths last. The
pieces find their places in the plan by their rank among pieces of the same length.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.common import materialize

#: Words whose ids a worker remembers, and documents it works on at once: bounds on memory.
CACHE, AT_ONCE = 150_000, 256
#: Cut pieces that are looked up by broadcast; more of them are joined.
FEW = 50_000
#: How byte-level tokenizers split text before merging (fixed value of the public format).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A single space between two visible characters always starts a new word of the tokenizer.
APART = re.compile(r"(?<=\S) (?=\S)")

PIECE = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("place", pa.int64())])

_loaded: dict = {}


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks by bytes of a byte-level BPE file whose ids follow its merges, else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return None
    # Bytes that print stand for themselves, the others for characters from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocab = model["vocab"]
    if any(vocab.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}


class _Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; words met before come from a cache.

    Words are split by tiktoken where the file's ranks allow it, which gives the same ids sooner;
    texts with special tokens, and other kinds of files, go through tokenizers.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.whole = path, None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks, self.fast = merge_ranks(spec), None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding(path, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _slow(self, texts: list[str]) -> list[bytes]:
        if self.whole is None:  # loaded only where it is needed, as it takes memory
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.whole = Tokenizer.from_file(self.path)
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, cache: dict[str, bytes], words: list[str], lead: str) -> None:
        slow = [w for w in words if any(s in w for s in self.special)] if self.fast else words
        if self.fast:
            for w in words:
                cache[w] = array("I", self.fast(lead + w)).tobytes()
        if slow:
            cache.update(zip(slow, self._slow([lead + w for w in slow]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for t in texts:
            words = t.split(" ")
            plain = "" not in words and "\n " not in t and " \n" not in t and t.replace("\n", "").isprintable()
            split.append(words if plain else APART.split(t))
        if len(self.first) + len(self.later) > CACHE:
            self.first, self.later = {}, {}
        heads, tails = [w[0] for w in split], [w[1:] for w in split]
        self._learn(self.first, list(set(heads).difference(self.first)), "")
        self._learn(self.later, list(set().union(*tails).difference(self.later)), " ")
        get = self.later.__getitem__
        return [self.first[w] + b"".join(map(get, rest)) for w, rest in zip(heads, tails, strict=True)]


def encoder(path: str) -> _Encoder:
    """The encoder of a tokenizer file, loaded once in a worker."""
    if path not in _loaded:
        _loaded[path] = _Encoder(path)
    return _loaded[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, start, length, doc_tokens, ids, part, place): windows of each document and its rest.

    ids: little-endian unsigned 32-bit. part and place number the pieces of each length in a task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        end, width = np.array([end_id], "<u4").tobytes(), 4 * window
        next_place = np.zeros(window + 1, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(i, AT_ONCE)
                rows = []
                for doc, ids in zip(some.column("id").to_pylist(), ids_of.encode([t or "" for t in some.column("body").to_pylist()]), strict=True):
                    ids += end
                    for at in range(0, len(ids), width):
                        piece = ids[at : at + width]
                        n = len(piece) // 4
                        rows.append((doc, at // 4, n, len(ids) // 4, piece, part, int(next_place[n])))
                        next_place[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PIECE, strict=True)], schema=PIECE)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return source.mapInArrow(cut, "id long, start long, length long, doc_tokens long, ids binary, part int, place long")


def best_fill(counts: Mapping[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum comes closest to room from below."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # (length, copies, sums reachable before)
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, block = min(counts[length], room // length), 1
        while left:
            copies = min(block, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & mask
            left, block = left - copies, block * 2
            if reach >> room:
                break
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + copies
            total -= length * copies
    return used


def plan_windows(counts: Mapping[int, int], window: int) -> list[tuple[int, int, int, int, int, int, int, int, int]]:
    """Slots (whole, low, high, cut_from, length, copies, ahead, sequence, at), a few for each length.

    Pieces of length `whole` with ranks low to high (exclusive) give their ids from cut_from on,
    `length` of them, to the windows from `sequence` on: `copies` a window, from position `at`;
    `ahead` ranks of other slots come before. A window takes the longest length left and the
    lengths that fill it best; only where some slack remains is another piece cut to fill it.
    """
    pool: dict[int, list[list[int]]] = {n: [[n, 0, c, 0]] for n, c in counts.items() if c}  # [whole, low, count, cut_from]
    left = {n: c for n, c in counts.items() if c}
    slots, sequence = [], 0

    def take(n: int, copies: int, repeats: int, length: int, at: int) -> None:
        wanted, ahead = copies * repeats, 0
        left[n] -= wanted
        while wanted:
            part = pool[n][-1]
            got = min(wanted, part[2])
            slots.append((part[0], part[1], part[1] + got, part[3], length, copies, ahead, sequence, at))
            if length < n:  # what is left of the cut pieces
                pool.setdefault(n - length, []).append([part[0], part[1], got, part[3] + length])
                left[n - length] = left.get(n - length, 0) + got
            part[1], part[2] = part[1] + got, part[2] - got
            wanted, ahead = wanted - got, ahead + got
            if not part[2]:
                pool[n].remove(part)
        if not left[n]:
            del left[n]

    while left:
        longest = max(left)
        rest = {n: c - (n == longest) for n, c in left.items() if c > (n == longest)}
        pattern = best_fill(rest, window - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        slack = window - sum(n * k for n, k in pattern.items())
        over = [n for n, c in left.items() if c > pattern.get(n, 0)] if slack else []
        need = dict(pattern)
        if over:
            need[max(over)] = need.get(max(over), 0) + 1
        repeats = min(left[n] // k for n, k in need.items())
        at = 0
        for n, k in sorted(pattern.items(), reverse=True):
            take(n, k, repeats, n, at)
            at += n * k
        if over:
            take(max(over), 1, repeats, slack, at)
        sequence += repeats
    return slots


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", emit: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per piece: id, start, length, the emitted columns, doc_tokens, sequence_id, offset.

    emit: columns over the piece's `ids` (little-endian unsigned 32-bit), by name; the ids
    themselves by default. They are computed before the shuffle, so what isn't emitted isn't sent.
    Null and empty texts are the end id alone. Repeated rows and null ids are documents of their
    own. Texts of any length are cut into windows. All windows but one are full. An empty table
    gives no rows. Strings of special tokens are read as the tokenizer does. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    emit = emit or {"ids": F.col("ids")}
    names = list(emit)
    pieces = materialize(token_pieces(docs, tokenizer_path, window, end_id, id_col, text_col), "pack-pieces")
    per = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # At most `window` rows, whatever the input.
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan_windows(counts, window)
    plan = spark.createDataFrame(
        slots,
        "whole long, low long, high long, cut_from long, cut_length long, copies long, ahead long, sequence long, at long",
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def placed(rows: DataFrame, slots: DataFrame) -> DataFrame:
        ranked = rows.join(bases, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
        found = ranked.join(F.broadcast(slots), F.expr("length = whole and rank >= low and rank < high"))
        nth = F.col("rank") - F.col("low") + F.col("ahead")
        return found.withColumn("sequence_id", F.col("sequence") + F.floor(nth / F.col("copies"))).withColumn("offset", F.col("at") + F.pmod(nth, F.col("copies")) * F.col("cut_length"))

    whole = placed(pieces.select("id", "start", "length", "doc_tokens", "part", "place", *[c.alias(n) for n, c in emit.items()]), plan.where("cut_length = whole"))
    whole = whole.select(F.col("id").alias(id_col), "start", "length", *names, "doc_tokens", "sequence_id", "offset")
    # Cut pieces are looked up again for their ids.
    cuts = placed(pieces.select("part", "length", "place"), plan.where("cut_length < whole")).select("part", "length", "place", "cut_from", "cut_length", "sequence_id", "offset")
    n_cut = sum(high - low for whole, low, high, _, length, *_ in slots if length < whole)
    cut = pieces.join(F.broadcast(cuts) if n_cut <= FEW else cuts, ["part", "length", "place"]).select(
        F.col("id").alias(id_col), (F.col("start") + F.col("cut_from")).alias("start"), F.col("cut_length").alias("length"), "doc_tokens", "sequence_id", "offset",
        F.expr("substring(ids, cast(4 * cut_from + 1 as int), cast(4 * cut_length as int))").alias("ids"),
    )
    return whole.union(cut.select(id_col, "start", "length", *[c.alias(n) for n, c in emit.items()], "doc_tokens", "sequence_id", "offset"))
