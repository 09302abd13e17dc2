"""Alignment of two tokenizers over the same text, and how often their tokens meet in a corpus.

Both id sequences of a text run through a transducer: its state is the side that leads and the
bytes of that side's last token which the other side hasn't matched yet. A token of the side
behind is matched against them; where nothing is left over, a group closes. Transitions depend
on the residual and the next token alone and are remembered, and so are whole words: a single
space between visible characters starts a new token on both sides, so a group closes there.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import materialize
from vigilframe.llm.packing import APART, BYTE_LEVEL, merge_ranks

#: Words and transitions that a worker remembers, documents it works on at once, and pairs of ids whose counts are broadcast: bounds on memory.
WORDS, STEPS, AT_ONCE, HEAD = 150_000, 300_000, 128, 1_000_000
NO_SIDE, A_LEADS, B_LEADS = 0, 1, 2

ALIGNED = pa.schema([
    ("id", pa.int64()), ("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
])
#: A pair of ids as one number.
PAIR_BITS = 32

_loaded: dict = {}


class Transducer:
    """Aligns two token sequences given the bytes of every id of both sides."""

    def __init__(self, a_bytes: dict[int, bytes], b_bytes: dict[int, bytes]) -> None:
        self.bytes_of = {B_LEADS: a_bytes, A_LEADS: b_bytes}
        self.memo: dict[tuple[int, bytes, int], tuple[int, bytes] | None] = {}

    def _step(self, lead: int, residual: bytes, token: int) -> tuple[int, bytes] | None:
        """State after the side behind gives a token; None if its bytes aren't those of the residual."""
        b = self.bytes_of[lead][token]
        if len(b) <= len(residual):
            rest = residual[len(b) :]
            return (lead if rest else NO_SIDE, rest) if residual.startswith(b) else None
        return (A_LEADS if lead == B_LEADS else B_LEADS, b[len(residual) :]) if b.startswith(residual) else None

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]] | None:
        """Groups of ids, and the pairs of ids whose bytes overlap; None if the bytes of both sides differ."""
        memo, first = self.memo, self.bytes_of[B_LEADS]
        if len(memo) > STEPS:
            memo.clear()
        groups, links, lead, residual, i, k, from_a, from_b = [], [], NO_SIDE, b"", 0, 0, 0, 0
        while True:
            if lead == NO_SIDE:
                if i > from_a:
                    groups.append((a[from_a:i], b[from_b:k]))
                    from_a, from_b = i, k
                if i == len(a) or k == len(b):
                    return (groups, links) if i == len(a) and k == len(b) else None
                lead, residual, i = A_LEADS, first[a[i]], i + 1
            side = b if lead == A_LEADS else a
            at = k if lead == A_LEADS else i
            if at == len(side):
                return None
            token = side[at]
            if lead == A_LEADS:
                links.append((a[i - 1], token))
                k += 1
            else:
                links.append((token, b[k - 1]))
                i += 1
            key = (lead, residual, token)
            state = memo.get(key)
            if state is None:
                state = memo[key] = self._step(*key)
                if state is None:
                    return None
            lead, residual = state


class _Aligner:
    """Per-word results of two tokenizer files: a byte-level one and one of pieces."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = merge_ranks(spec)
        if ranks is None:
            raise ValueError("side A must be a byte-level file whose ids follow its merges")
        # Strings of special tokens are plain text.
        self.encode_a = tiktoken.Encoding(a_path, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.encode_b = lambda texts: pieces.encode(texts, num_threads=1)
        self.a_bytes = {i: t for t, i in ranks.items()}
        self.b_bytes = {}
        for i in range(pieces.get_piece_size()):
            text = pieces.id_to_piece(i)
            self.b_bytes[i] = bytes([int(text[3:5], 16)]) if pieces.is_byte(i) else text.replace("▁", " ").encode()
        # Pieces that hold a space after a letter would reach over words.
        self.by_word = not any(" " in t.lstrip(b" ").decode(errors="ignore") for t in self.b_bytes.values())
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def _align(self, text: str, b: list[int]) -> tuple[int, int, bytes, bytes] | None:
        """Ids of A, groups, the groups as text and the pairs as numbers; None where bytes differ."""
        a, target = self.encode_a(" " + text), (" " + text).encode()
        if b"".join([self.a_bytes[x] for x in a]) != target or b"".join([self.b_bytes[x] for x in b]) != target:
            return None
        groups, links = self.transducer.align(a, b)
        shown = ";".join([",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups]).encode()
        return len(a), len(groups), shown, array("q", [x << PAIR_BITS | y for x, y in links]).tobytes()

    def words(self, texts: list[str]) -> list[list[tuple | None]]:
        """What each text is made up of; results of words met before are taken from memory."""
        split = [APART.split(t) if self.by_word else [t] for t in texts]
        if len(self.young) > WORDS // 2:
            self.old, self.young = self.young, {}
        new = []
        for w in set().union(*split).difference(self.young):
            if w in self.old:
                self.young[w] = self.old[w]
            else:
                new.append(w)
        for w, b in zip(new, self.encode_b(new), strict=True):
            self.young[w] = self._align(w, b)
        get = self.young.__getitem__
        return [list(map(get, s)) for s in split]


def aligner(a_path: str, b_path: str) -> _Aligner:
    """The aligner of two files, loaded once in a worker."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = _Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): a row per document.

    pairs: the different linked pairs of ids, each a number (a << 32 | b), with how often each is
    linked. row numbers the documents.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 40
        none = np.empty(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                texts = [t or "" for t in some.column("body").to_pylist()]
                columns, pairs, times = [], [], []
                for doc, text, words in zip(some.column("id").to_pylist(), texts, tool.words(texts), strict=True):
                    known = text and None not in words
                    n_a, groups, shown, codes = zip(*words, strict=True) if known else ((0,), (0,), (), ())
                    linked = np.frombuffer(b"".join(codes), np.int64)
                    found, often = np.unique(linked, return_counts=True) if known else (none, none)
                    pairs.append(found)
                    times.append(often)
                    n_b = len(linked) + sum(groups) - sum(n_a)  # a group of n and m ids has n + m - 1 links
                    columns.append((doc, row, sum(n_a), n_b, sum(groups), len(linked), hashlib.sha256(b";".join(shown)).hexdigest() if known else ""))
                    row += 1
                ends = pa.array(np.r_[0, np.cumsum([len(p) for p in pairs])].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (pairs, times)]
                plain = [pa.array(x, f.type) for x, f in zip(zip(*columns, strict=True), ALIGNED, strict=False)]
                yield pa.RecordBatch.from_arrays([*plain, *lists], schema=ALIGNED)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return source.mapInArrow(work, "id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): the documents that hold a pair linked; best if no pair of the same A id has more."""
    counts = materialize(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "align-counts")
    side = F.shiftright("pair", PAIR_BITS)
    # At most one row for each id of A's vocabulary.
    most = counts.groupBy(side.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), side == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A: ids of the byte-level file for a space and the text; B: ids of the piece model for the
    text, which adds the space itself. A link is an occurrence of an A and a B token whose bytes
    overlap; its count is the number of documents that hold its pair of ids linked. n_best: links
    whose count is the highest of their A id, ties included; count_sum: counts over all links.
    Null and empty texts, and texts whose bytes either side doesn't give back, have no tokens:
    zeros and an empty digest. Repeated rows and null ids are documents of their own; texts are
    read whole; an empty table gives no rows; other columns are ignored.

    Counts of the `head` most frequent pairs are broadcast. Should there be more pairs, documents
    that hold others get their counts by a join.
    """
    spark = docs.sparkSession
    found = materialize(aligned(docs, a_path, b_path, id_col, text_col), "align-docs")
    counts = materialize(pair_counts(found), "align-pairs")
    frequent = counts.orderBy(F.desc("n"), "pair").limit(head).toArrow()  # at most head rows
    order = np.argsort(pairs := frequent.column("pair").to_numpy())
    known = spark.sparkContext.broadcast((pairs[order], frequent.column("n").to_numpy()[order], frequent.column("best").to_numpy(zero_copy_only=False)[order]))
    out_schema = pa.schema([*list(ALIGNED)[:7], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        for whole in batches:
            for start in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(start, AT_ONCE)
                of = np.repeat(np.arange(batch.num_rows), batch.column("pairs").value_lengths().to_numpy())
                pairs, times = batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy()
                at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
                hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                sums = []
                for value in (best, n):
                    sums.append(np.zeros(batch.num_rows, np.int64))
                    np.add.at(sums[-1], of[hit], times[hit] * value[at[hit]])
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(of[~hit], minlength=batch.num_rows))].astype(np.int32))
                rest = [pa.ListArray.from_arrays(ends, pa.array(x[~hit])) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], *map(pa.array, sums), *rest], schema=out_schema)

    scored = found.mapInArrow(look_up, "id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>")
    if len(pairs) >= head:
        scored = materialize(scored, "align-scored")
        asked = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        rare = asked.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
        scored = scored.join(rare, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return scored.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
