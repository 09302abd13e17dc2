"""Language-model scores from a log-frequency Bloom filter.

Tasks count the words and word pairs of their texts by hash and send them as blocks, one per
filter segment; each segment is built where its blocks meet. A count c is kept as
1 + floor(log2 c) levels, each entered on its own, so that a count is read back by probing one
level after the other until a probe misses. A segment's size follows the levels entered in it,
and the number of segments follows the size of the corpus, so false hits stay as rare, and a
segment as small, however large the input is.

A filter of at most MAX_BROADCAST bytes is broadcast to the workers. Of a larger one the levels
of the most frequent pairs are, as the filter reads them; its segments stay rows: texts ask for
their other pairs by segment, and the answers meet the texts again by block. Both ways read the
same filter and give the same scores. Scores interpolate the pair's relative frequency with the
word's. Word counts are exact: the most frequent words are broadcast, the counts of the others
are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm import textnum
from vigilframe.llm.common import materialize

#: Fewest filter segments, and the bytes of text from which each segment is filled at most.
SEGMENTS, SEGMENT_BYTES = 1024, 16 << 20
PROBES = 4
#: Filter bits for each level entered: with four probes about 1.2 % of absent levels are hit.
BITS_PER_LEVEL = 10
#: Bytes of filter that are broadcast; a larger filter is asked by segment.
MAX_BROADCAST = 8 << 20
#: Words whose exact counts are broadcast, and pairs whose levels are; all others are asked for.
HEAD_WORDS, HEAD_PAIRS = 1 << 18, 1 << 20
#: Weight of the word's own frequency against the pair's, in counts (Dirichlet smoothing).
PRIOR = 200.0
#: Distinct grams a task holds before it sends them, and bytes of text that ask together.
HELD, BLOCK = 2_000_000, 8 << 20
MAX_LEVEL = 40
#: Kept by the worker: making one costs more than packing a block.
_PRESS, _UNPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _with_ends(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash, hash before it) with one end after the words of each document."""
    counts = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    size = len(h) + n_docs
    at_end = np.cumsum(counts + 1) - 1
    out = np.full(size, textnum.END, np.uint64)
    inner = np.ones(size, bool)
    inner[at_end] = False
    out[inner] = h
    before = np.empty(size, np.uint64)
    before[1:] = out[:-1]
    first = np.concatenate([[0], at_end[:-1] + 1]).astype(np.int64)
    before[first] = textnum.BEGIN
    return np.repeat(np.arange(n_docs), counts + 1), out, before


def _tokens(texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, n, doc, hash, hash before) for runs of n texts."""
    held = None
    for first, doc, h in textnum.word_hashes(texts):
        if held is not None:
            yield _run(held, first)
        held = (first, doc, h)
    if held is not None:
        yield _run(held, len(texts))


def _run(held: tuple, until: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    first, doc, h = held
    return first, until - first, *_with_ends(doc, h, until - first)


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[start], np.add.reduceat(c, start) if len(h) else c


def segments_for(n_bytes: int) -> int:
    """A power of two, in proportion to the text."""
    return max(SEGMENTS, 1 << max(0, -(-n_bytes // SEGMENT_BYTES) - 1).bit_length())


def _segment(h: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    return (h >> np.uint64(65 - segments.bit_length())).astype(np.int64)


def _rest(h: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The 32 bits after those of the segment."""
    return (h << np.uint64(segments.bit_length() - 1) >> np.uint64(32)).astype(np.uint32)


def _packed(a: np.ndarray, ascending: bool) -> bytes:
    """Numbers byte by byte, lowest first, as differences if they ascend: what is alike lies together."""
    if not len(a):
        return b""
    a = np.concatenate([a[:1], a[1:] - a[:-1]]) if ascending else a
    return _PRESS.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpacked(data: bytes, kind: str, ascending: bool) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    width = np.dtype(kind).itemsize
    a = np.ascontiguousarray(np.frombuffer(_UNPRESS.decompress(data), np.uint8).reshape(width, -1).T).view(kind)[:, 0]
    return np.cumsum(a, dtype=kind) if ascending else a


def _joined(column: pd.Series, kind: str, ascending: bool) -> list[np.ndarray]:
    return [_unpacked(x, kind, ascending) for x in column] or [np.empty(0, kind)]


def _cuts(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(segments that occur, where each begins and the last ends) of sorted hashes."""
    seg = _segment(h, segments)
    start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(h) else np.empty(0, np.int64)
    return seg[start], np.append(start, len(h))


def _by_segment(groups: list[tuple[np.ndarray, dict[str, np.ndarray]]], segments: int, ascending: tuple = ()) -> pd.DataFrame:
    """One row per segment with the packed numbers of each array; groups: (sorted hashes, arrays by column)."""
    frames = []
    for h, arrays in groups:
        seg, cut = _cuts(h, segments)
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        frames.append(pd.DataFrame({"segment": seg} | {name: [_packed(a[i:j], name in ascending) for i, j in spans] for name, a in arrays.items()}).set_index("segment"))
    out = frames[0].join(frames[1:], how="outer") if len(frames) > 1 else frames[0]
    return out.astype(object).where(out.notna(), b"").reset_index()


def count_grams(docs: DataFrame, text_col: str, segments: int = SEGMENTS) -> DataFrame:
    """(segment, words, ns, grams, counts): blocks of counted words and pairs, a row per task and segment."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: list = []
        grams: list = []
        joined = lambda x: _summed(*(np.concatenate(y) for y in zip(*x, strict=True)))

        def send() -> pd.DataFrame:
            h, c = joined(words)
            g, k = joined(grams)
            words.clear()
            grams.clear()
            return _by_segment([(h, {"words": h.astype("<u8"), "ns": c.astype("<i8")}), (g, {"grams": _rest(g, segments).astype("<u4"), "counts": np.minimum(k, 0xFFFFFFFF).astype("<u4")})], segments, ("words", "grams"))

        held = 0
        for pdf in batches:
            for _, _, _, h, before in _tokens(list(pdf["body"])):
                words.append(np.unique(h, return_counts=True))
                grams.append(np.unique(textnum.pair(before, h), return_counts=True))
                held += len(grams[-1][0])
                if held > HELD:
                    grams[:], words[:] = [joined(grams)], [joined(words)]
                    held = len(grams[0][0])
                    if held > HELD // 2:
                        yield send()
                        held = 0
        if words:
            yield send()

    body = docs.select(F.col(text_col).cast("binary").alias("body"))
    return body.mapInPandas(count, "segment long, words binary, ns binary, grams binary, counts binary")


def _places(rest: np.ndarray, level: np.ndarray | int, bits: int) -> Iterator[np.ndarray]:
    """Bit positions in a segment of `bits` bits of each (gram, level)."""
    x = textnum.mix(rest.astype(np.uint64) * np.uint64(64) + np.asarray(level, np.uint64))
    a, b = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)
    for i in range(PROBES):
        yield ((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * np.uint64(bits) >> np.uint64(32)


def _segment_bits(rest: np.ndarray, c: np.ndarray, bits_per_level: int = BITS_PER_LEVEL) -> bytes:
    """The filter of one segment from distinct grams, as large as the levels entered in it ask for."""
    top = np.minimum(np.log2(c).astype(np.int64) + 1, MAX_LEVEL)
    width = max(8, -(-int(top.sum()) * bits_per_level // 8))
    hit = np.zeros(8 * width, bool)
    for level in range(1, int(top.max(initial=0)) + 1):
        for at in _places(rest[top >= level], level, 8 * width):
            hit[at] = True
    return np.packbits(hit, bitorder="little").tobytes()


def build_filter(blocks: DataFrame) -> DataFrame:
    """The filter as (segment, bits) rows from (segment, grams, counts), both little-endian unsigned 32-bit."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = _summed(np.frombuffer(b"".join(pdf["grams"]), "<u4"), np.frombuffer(b"".join(pdf["counts"]), "<u4").astype(np.int64))
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "bits": [_segment_bits(*grams)]})

    return blocks.groupBy("segment").applyInPandas(build, "segment long, bits binary")


def _levels(bits: bytes | np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The last level of each gram that the segment's filter hits, by repeated probes."""
    flat = np.frombuffer(bits, np.uint8)
    level, asked = np.zeros(len(rest), np.uint8), np.arange(len(rest))
    for q in range(1, MAX_LEVEL + 1):
        hit = np.ones(len(asked), bool)
        for at in _places(rest[asked], q, 8 * len(flat)):
            hit &= (flat[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        asked = asked[hit]
        if not len(asked):
            break
        level[asked] = q
    return level


def _middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: 0 for none, else the middle of its counts."""
    return np.where(level > 1, 0.75 * 2.0**level - 0.5, level.astype(float))


def probe(filter_: DataFrame, gram: np.ndarray) -> np.ndarray:
    """Counts of grams by the (segment, bits) rows of a small filter."""
    level, seg, rest = np.zeros(len(gram), np.uint8), _segment(gram), _rest(gram)
    for row in filter_.toLocalIterator():
        mine = seg == row["segment"]
        level[mine] = _levels(bytes(row["bits"]), rest[mine])
    return _middle(level)


STORE = "segment long, bits binary, words binary, ns binary, tokens long, n_words long, ends long, top array<struct<word:long,n:long>>, pairs binary, levels binary"


def _store(blocks: DataFrame, head_words: int, head_pairs: int, segments: int, bits_per_level: int) -> DataFrame:
    """A row per segment: its filter, the exact counts of its words, totals, its most frequent words and pairs."""
    most_words, most_pairs = 16 + 8 * head_words // segments, -(-head_pairs // segments)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        segment = int(pdf["segment"].iloc[0])
        h, n = _summed(np.concatenate(_joined(pdf["words"], "<u8", True)), np.concatenate(_joined(pdf["ns"], "<i8", False)))
        rest, c = _summed(np.concatenate(_joined(pdf["grams"], "<u4", True)), np.concatenate(_joined(pdf["counts"], "<u4", False)).astype(np.int64))
        bits = _segment_bits(rest, c, bits_per_level)
        top = np.lexsort([h, -n])[:most_words]
        often = np.sort(rest[np.lexsort([rest, -c])[:most_pairs]])
        return pd.DataFrame({
            "segment": [segment], "bits": [bits], "words": [_packed(h, True)], "ns": [_packed(n, False)],
            "tokens": [int(n.sum())], "n_words": [len(h)], "ends": [int(n[h == np.uint64(textnum.END)].sum())],
            "top": [[{"word": w, "n": x} for w, x in zip(h[top].view(np.int64).tolist(), n[top].tolist(), strict=True)]],
            "pairs": [often.astype("<u4").tobytes()], "levels": [_levels(bits, often).tobytes()],
        })

    return blocks.groupBy("segment").applyInPandas(build, STORE)


@dataclass
class LanguageModel:
    """What scoring needs; only what has a bounded size leaves Spark."""

    store: DataFrame  # (segment, bits, words, ns): the filter and the counts of all words
    segments: int
    head: Broadcast  # (hashes sorted, counts) of the most frequent words
    filter: Broadcast | None  # (bytes of all segments, where each begins); None where it is too large
    pairs: Broadcast  # (segment and rest sorted, levels) of the most frequent pairs; none where the filter is here
    n_tokens: int
    n_words: int
    n_docs: int


def fit(spark: SparkSession, docs: DataFrame, text_col: str = "text", head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS, max_broadcast: int = MAX_BROADCAST, bits_per_level: int = BITS_PER_LEVEL) -> LanguageModel:
    """Counts all words and pairs of the documents.

    Null and empty texts are one end. An empty table gives a model without words. Words are told
    apart by 64 bits of hash. head_words, head_pairs and max_broadcast decide how counts are
    read, not what they are.
    """
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
    segments = segments_for(n_bytes)
    store = materialize(_store(count_grams(docs, text_col, segments), head_words, head_pairs, segments, bits_per_level), "lm-store")
    count = store.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "n_words", "ends")], F.coalesce(F.sum(F.length("bits")), F.lit(0)).alias("width")).first()
    head = store.select(F.inline("top")).orderBy(F.desc("n"), "word").limit(head_words).toPandas()
    h = head["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    whole, keys, levels = None, [np.empty(0, np.uint64)], [np.empty(0, np.uint8)]
    if count["width"] <= max_broadcast:
        begins, at = np.zeros(segments + 1, np.int64), 0
        flat = np.zeros(count["width"], np.uint8)
        for row in store.select("segment", "bits").orderBy("segment").toLocalIterator():
            flat[at : at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
            at += len(row["bits"])
            begins[row["segment"] + 1 :] = at
        whole = spark.sparkContext.broadcast((flat, begins))
    else:
        # At most head_pairs of them: a few from each segment, or some segments' where there are more segments.
        some = store.where(F.pmod("segment", F.lit(max(1, segments // max(1, head_pairs)))) == 0).select("segment", "pairs", "levels")
        for row in some.orderBy("segment").toLocalIterator():
            keys.append(np.uint64(row["segment"] << 32) | np.frombuffer(row["pairs"], "<u4").astype(np.uint64))
            levels.append(np.frombuffer(row["levels"], np.uint8))
    send = spark.sparkContext.broadcast
    return LanguageModel(
        store.select("segment", "bits", "words", "ns"), segments, send((h[order], head["n"].to_numpy(np.int64)[order])), whole,
        send((np.concatenate(keys), np.concatenate(levels))), count["tokens"], count["n_words"], count["ends"],
    )


def _known(words: np.ndarray, counts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count or 0, whether it is there) of each word in sorted words."""
    if not len(words):
        return np.zeros(len(h), counts.dtype), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    known = words[at] == h
    return np.where(known, counts[at], 0), known


def _read(whole: tuple[np.ndarray, np.ndarray], gram: np.ndarray) -> np.ndarray:
    """Levels of sorted grams by a filter that is here."""
    flat, begins = whole
    seg, rest = _segment(gram, len(begins) - 1), _rest(gram, len(begins) - 1)
    level, start, width = np.zeros(len(gram), np.uint8), begins[seg], np.diff(begins)[seg] * 8
    asked = np.flatnonzero(width)
    for q in range(1, MAX_LEVEL + 1):
        hit = np.ones(len(asked), bool)
        for at in _places(rest[asked], q, width[asked].astype(np.uint64)):
            hit &= (flat[start[asked] + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        asked = asked[hit]
        if not len(asked):
            break
        level[asked] = q
    return level


def _answered(key: tuple, asked: pd.DataFrame, store: pd.DataFrame) -> pd.DataFrame:
    """Levels of the pairs and counts of the words that blocks ask one segment for."""
    if not len(asked):
        return pd.DataFrame({"block": [], "segment": [], "levels": [], "ns": []})
    grams, words = _joined(asked["grams"], "<u4", True), _joined(asked["words"], "<u8", True)
    rest, h = np.concatenate(grams), np.concatenate(words)
    level, n = np.zeros(len(rest), np.uint8), np.zeros(len(h), np.int64)
    for bits, known, ns in zip(store["bits"], store["words"], store["ns"], strict=True):
        level = _levels(bits, rest)
        n, _ = _known(_unpacked(known, "<u8", True), _unpacked(ns, "<i8", False), h)
    g, w = (np.cumsum([0, *map(len, x)]) for x in (grams, words))
    return pd.DataFrame({
        "block": asked["block"], "segment": asked["segment"],
        "levels": [_packed(level[i:j], False) for i, j in zip(g[:-1], g[1:], strict=True)], "ns": [_packed(n[i:j], False) for i, j in zip(w[:-1], w[1:], strict=True)],
    })


def _distinct(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, words) of texts, sorted and distinct."""
    some = [(np.unique(textnum.pair(before, h)), np.unique(h)) for _, _, _, h, before in _tokens(texts)]
    return tuple(np.unique(np.concatenate(x)) for x in zip(*some, strict=True))


BLOCKS = "block long, size long, ids array<string>, held array<boolean>, lengths binary, bodies binary, segment long, grams binary, words binary"


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, prior: float = PRIOR, block_bytes: int = BLOCK) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the exact add-half word model, score the filter's pair model interpolated with
    it; both are log10 probabilities of the whole text, its end included. Null and empty texts
    are one end. Very long texts are read whole, each a block of its own. Repeated rows and null
    ids are scored like any other row; an empty table gives no rows. Other columns are ignored.
    """
    head, whole, frequent, segments = model.head, model.filter, model.pairs, model.segments
    drop = np.uint64(33 - segments.bit_length())  # bits of a hash that neither name a segment nor tell its grams apart
    n_docs, n_all = float(model.n_docs), model.n_tokens
    spread = model.n_tokens + 0.5 * (model.n_words + 1)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of texts, and what each block asks the segments for."""
        block, size, parts = TaskContext.get().partitionId() << 33, 0, []
        nothing = {c: None for c in ("size", "ids", "held", "lengths", "bodies")}

        def send() -> Iterator[pd.DataFrame]:
            texts = [t for part in parts for t in part["body"]]
            yield pd.DataFrame({
                "block": [block], "size": [size], "ids": [[x for part in parts for x in part["id"]]], "held": [[x for part in parts for x in part["held_out"]]],
                "lengths": [np.array([len(t) for t in texts], "<i8").tobytes()], "bodies": [zstandard.compress(b"".join(texts))], "segment": None, "grams": None, "words": None,
            })
            g, w = _distinct(texts)
            w = w[~_known(*head.value, w)[1]]
            asks = [(w, {"words": w.astype("<u8")})]
            if whole is None:
                g = g[~_known(*frequent.value, g >> drop)[1]]
                asks.append((g, {"grams": _rest(g, segments).astype("<u4")}))
            rows = _by_segment(asks, segments, ("words", "grams"))
            if len(rows):
                yield rows.assign(block=block, **nothing, **({} if whole is None else {"grams": b""}))[["block", *nothing, "segment", "grams", "words"]]

        for pdf in batches:
            pdf = pdf.assign(body=[t or b"" for t in pdf["body"]])
            ends = np.cumsum(pdf["body"].map(len).to_numpy(np.int64))
            at = 0
            while at < len(pdf):
                until = max(at + 1, int(np.searchsorted(ends, block_bytes - size + (ends[at - 1] if at else 0), side="right")))
                parts.append(pdf.iloc[at:until])
                size += int(ends[until - 1] - (ends[at - 1] if at else 0))
                at = until
                if size >= block_bytes or at < len(pdf):
                    yield from send()
                    block, size, parts = block + 1, 0, []
        if parts:
            yield from send()

    def run(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, held, lengths, bodies in zip(pdf["ids"], pdf["held"], pdf["lengths"], pdf["bodies"], strict=True):
            flat, ends = zstandard.decompress(bodies), np.cumsum(np.frombuffer(lengths, "<i8"))
            texts = [flat[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
            answers = answers.sort_values("segment")
            grams, words = _distinct(texts)
            if whole is None:
                level, often = _known(*frequent.value, grams >> drop)
                level[~often] = np.concatenate(_joined(answers["levels"], "u1", False))
            else:
                level = _read(whole.value, grams)
            count, common = _known(*head.value, words)
            count[~common] = np.concatenate(_joined(answers["ns"], "<i8", False))
            for first, n, doc, h, before in _tokens(texts):
                seen = count[np.searchsorted(words, h)].astype(float)
                context = np.empty(len(h))
                context[1:] = seen[:-1]
                context[before == np.uint64(textnum.BEGIN)] = n_docs
                both = np.minimum(_middle(level[np.searchsorted(grams, textnum.pair(before, h))]), np.minimum(context, seen))
                p_word = (seen + 0.5) / spread
                logs = np.log10((both + prior * p_word) / (context + prior))
                out.append(pd.DataFrame({
                    "id": ids[first : first + n], "held_out": held[first : first + n], "n_tokens": np.bincount(doc, minlength=n), "n_known": np.bincount(doc, seen > 0, n).astype(np.int64),
                    "base_score": np.bincount(doc, np.log10(p_word), n), "score": np.bincount(doc, logs, n),
                }))
        return pd.concat(out)

    held = F.lit(False) if held_out is None else held_out
    source = docs.select(F.col(id_col).cast("string").alias("id"), held.alias("held_out"), F.col(text_col).cast("binary").alias("body"))
    rows = materialize(source.mapInPandas(ask, BLOCKS), "lm-asked")
    asked = rows.where("segment is not null").select("block", "segment", "grams", "words")
    blocks = rows.where("segment is null").select("block", "size", "ids", "held", "lengths", "bodies")
    # Texts many times the training text ask each segment in slices, so that no group outgrows a task.
    slices = max(1, -(-(blocks.agg(F.sum("size").alias("n")).first()["n"] or 0) // (segments * SEGMENT_BYTES)))
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)))
    store = model.store.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    answers = asked.groupBy("segment", "slice").cogroup(store.groupBy("segment", "slice")).applyInPandas(_answered, "block long, segment long, levels binary, ns binary")
    scored = blocks.drop("size").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").cast("long").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
