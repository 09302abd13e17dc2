"""Quality classifier on random-indexing word vectors.

Each word has a sparse random index vector; a word's vector sums the index vectors of the words
around it, over the whole corpus. Words share a table of fixed size by hash, so it can go to the
workers whatever the vocabulary. Documents pool the vectors of their words, a two-layer network
is trained with numpy on a bounded sample of labelled rows, and a temperature fitted on rows that
it did not see calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm import textnum

DIM, BUCKETS, SPANS = 64, 1 << 15, 64
#: Words on each side that count as context, and entries of an index vector.
REACH, ENTRIES = 2, 4
#: A word's weight in a pool is SMOOTH / (SMOOTH + its share of all words).
SMOOTH = 1e-3
#: Most labelled rows that training uses, picked by the hash of their id.
MAX_TRAIN = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
#: Words pooled at once: a bound on memory.
SLICE = 1 << 16
#: Tables that one group adds up when word vectors are combined, and levels of that: enough for FAN ** LEVELS tasks.
FAN, LEVELS = 128, 3


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(49)).astype(np.int64)


def _entries(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(dimension, sign) of each entry of the words' index vectors."""
    for i in range(ENTRIES):
        piece = h >> np.uint64(8 * i)
        yield (piece & np.uint64(DIM - 1)).astype(np.int64), np.where(piece >> np.uint64(7) & np.uint64(1), 1.0, -1.0).astype(np.float32)


PARTS = "task long, span long, vectors binary, counts binary"


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in four bytes each where they fit; the first byte says which."""
    small = not numbers.size or np.abs(numbers).max() < 1 << 31
    return (b"\4" if small else b"\10") + numbers.astype("<i4" if small else "<i8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4" if data[:1] == b"\4" else "<i8", offset=1)


def combine(parts: DataFrame) -> DataFrame:
    """One row of PARTS a span, from one of each task: a tree, whose groups hold at most FAN rows up to two million tasks."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors, counts = np.zeros(BUCKETS * DIM // SPANS, np.int64), np.zeros(BUCKETS // SPANS, np.int64)
        for v, c in zip(pdf["vectors"], pdf["counts"], strict=True):
            vectors += _unpacked(v)
            counts += _unpacked(c)
        return pd.DataFrame({"task": [int(pdf["task"].iloc[0])], "span": [int(pdf["span"].iloc[0])], "vectors": [_packed(vectors)], "counts": [_packed(counts)]})

    for _ in range(LEVELS - 1):
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("span", "task").applyInPandas(add, PARTS)
    return parts.groupBy("span").applyInPandas(add, PARTS)


def word_vectors(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(vectors, counts) by bucket, from the contexts of all words of all documents."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Entries are whole numbers, so the sums are exact whatever the order.
        flat, seen = np.zeros(BUCKETS * DIM, np.int64), np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            for _, doc, h in textnum.word_hashes(list(pdf["body"]), lower=False):
                b = _bucket(h)
                np.add.at(seen, b, 1)
                entries = list(_entries(h))
                for step in range(1, REACH + 1):
                    near = doc[step:] == doc[:-step]
                    left, right = b[:-step][near] * DIM, b[step:][near] * DIM
                    for dim, sign in entries:
                        np.add.at(flat, left + dim[step:][near], sign[step:][near].astype(np.int64))
                        np.add.at(flat, right + dim[:-step][near], sign[:-step][near].astype(np.int64))
        table = flat.reshape(SPANS, -1)
        counts = seen.reshape(SPANS, -1)
        used = np.flatnonzero(counts.any(axis=1))
        yield pd.DataFrame({"task": TaskContext.get().partitionId(), "span": used, "vectors": [_packed(table[s]) for s in used], "counts": [_packed(counts[s]) for s in used]})

    parts = combine(docs.select(F.col(text_col).cast("binary").alias("body")).mapInPandas(gather, PARTS)).toPandas()
    table, counts = np.zeros((SPANS, BUCKETS * DIM // SPANS), np.float32), np.zeros((SPANS, BUCKETS // SPANS), np.int64)
    for s, v, c in zip(parts["span"], parts["vectors"], parts["counts"], strict=True):
        table[s], counts[s] = _unpacked(v), _unpacked(c)
    return table.reshape(BUCKETS, DIM), counts.reshape(-1)


def _pooling_table(vectors: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Vectors of length one without their common direction, times the word's weight; the weight last."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    total = max(1, counts.sum())
    weight = (SMOOTH / (SMOOTH + counts / total)).astype(np.float32)
    share = (weight * counts)[:, None]
    unit -= (unit * share).sum(axis=0) / max(1e-9, share.sum())
    return np.concatenate([unit * weight[:, None], weight[:, None]], axis=1).astype(np.float32)


def pool(texts: list, table: np.ndarray) -> np.ndarray:
    """(texts, DIM + 1): the weighted mean of the word vectors, and the log of the number of words."""
    sums, words = np.zeros((len(texts), DIM + 1)), np.zeros(len(texts))
    for first, doc, h in textnum.word_hashes(texts, lower=False):
        for s in range(0, len(h), SLICE):
            d, rows = doc[s : s + SLICE], table[_bucket(h[s : s + SLICE])]
            start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            sums[first + d[start]] += np.add.reduceat(rows, start, axis=0)
        np.add.at(words, first + doc, 1)
    return np.concatenate([sums[:, :DIM] / np.maximum(sums[:, DIM:], 1e-9), np.log1p(words)[:, None]], axis=1).astype(np.float32)


@dataclass
class Network:
    """Standardised inputs, one hidden layer of tanh, a sigmoid at a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train_network(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """Adam on cross-entropy over four fifths of the rows; the temperature comes from the rest."""
    rng = np.random.default_rng(seed)
    n, width = x.shape
    aside = np.arange(n) % 5 == 4 if n >= 50 else np.zeros(n, bool)
    tx, ty = x[~aside], y[~aside]
    net = Network(tx.mean(axis=0), tx.std(axis=0) + 1e-6, rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (tx - net.mean) / net.scale
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for s in range(0, len(order), BATCH):
            i = order[s : s + BATCH]
            a = np.tanh(z[i] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(a @ params[2] + params[3][0], -40, 40)))
            d = (p - ty[i]) / len(i)
            back = np.outer(d, params[2]) * (1 - a * a)
            grads = [z[i].T @ back + DECAY * params[0], back.sum(axis=0), a.T @ d + DECAY * params[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if aside.any():
        logits, truth = net.logits(x[aside]), y[aside]
        best = [(np.mean(np.logaddexp(0, np.where(truth > 0.5, -1, 1) * logits / t)), t) for t in np.geomspace(0.5, 8, 41)]
        net.temperature = float(min(best)[1])
    return net


@dataclass
class QualityModel:
    table: Broadcast
    network: Network | None  # None where no row was labelled


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, learn_from: Callable[[Column], Column] | None = None) -> QualityModel:
    """labels: (id, label 0 or 1). learn_from: over the labels' id, the rows whose label may be seen.

    Word vectors come from all documents. Null labels and ids are not used; a document with
    several labels has their rounded mean, and repeated rows train each. At most max_train ids and
    rows train; which ones, where there are more, is decided by hash, ties by id. Without any label, or with an
    empty table, the model scores 0.5. Columns of any name are fine.
    """
    table = spark.sparkContext.broadcast(_pooling_table(*word_vectors(docs, text_col)))
    allowed = labels.where(learn_from(F.col(id_col))) if learn_from is not None else labels
    known = allowed.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.round(F.avg(label_col)).cast("double").alias("__label"))
    # At most max_train rows of two numbers, so every task can have them.
    known = known.orderBy(F.xxhash64("__id", F.lit("quality")), "__id").limit(max_train)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    rows = source.join(F.broadcast(known), F.col("id") == F.col("__id")).select("id", "__label", "body")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["__label"], "x": list(pool(list(pdf["body"]), table.value))})

    # An id that is repeated very often must not fill the driver.
    got = rows.mapInPandas(features, "id long, label double, x array<float>").orderBy(F.xxhash64("id", "x"), "id").limit(max_train).toPandas()
    if not len(got):
        return QualityModel(table, None)
    got = got.iloc[np.lexsort([got["label"], textnum.mix(got["id"].to_numpy(np.int64).view(np.uint64))])]
    return QualityModel(table, train_network(np.stack(got["x"].to_list()).astype(float), got["label"].to_numpy()))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of docs with score, the probability of label 1.

    Null text is scored as empty. Very long texts are read whole, some words at a time. Repeated
    rows, and rows with null ids, get the score of their text; an empty table gives no rows. A
    column that is called score_col already is replaced.
    """
    table, network = model.table, model.network

    @F.pandas_udf("double")
    def scored(body: pd.Series) -> pd.Series:
        if network is None:
            return pd.Series(np.full(len(body), 0.5))
        return pd.Series(network.probability(pool(list(body), table.value)))

    return docs.withColumn(score_col, scored(F.col(text_col).cast("binary")))
