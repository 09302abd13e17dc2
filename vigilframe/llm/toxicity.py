"""Toxicity classifier by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else, whatever it is labelled, is just
unlabelled text. The risk of the negatives is what the unlabelled risk leaves after the class
prior's share of positives is taken out, kept from going below zero. The classifier is a sparse
logistic model over hashed words, trained with numpy on bounded samples.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm import textnum

BITS = 19
#: Besides whole words, their first bytes of these lengths are features: stems carry over to other endings.
HEADS = (2, 3, 4, 5, 6, 7)
#: Most documents of either sample, picked by the hash of their id.
MAX_POSITIVE, MAX_UNLABELLED = 3_000, 9_000
#: Most distinct words of a document that train, those of the smallest hash: with the samples' sizes a bound on the driver.
MAX_WORDS = 4_000
#: A word counts if so many sampled documents have it.
LEAST_DOCS = 3
#: Share of the positives that the cut may miss, measured on every fifth of them, which training doesn't see.
MISSED, ASIDE = 0.02, 5
#: Share of the clean text that the cut may take beyond the share of toxic documents.
SPARE = 0.02
EPOCHS, BATCH, RATE, SPARSE = 40, 1024, 0.02, 1e-3


def word_sets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) of the distinct hashed words of each text, in order of the texts."""
    keys = [np.unique((doc + first) << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64)) for first, doc, h in textnum.word_hashes(texts, punctuation=False, heads=HEADS)]
    flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
    return flat >> BITS, flat & ((1 << BITS) - 1)


def _few(words: np.ndarray, most: int = MAX_WORDS) -> np.ndarray:
    return words if len(words) <= most else np.sort(words[np.argpartition(textnum.mix(words.astype(np.uint64)), most)[:most]])


@dataclass
class ToxicityModel:
    weights: Broadcast  # one number per hashed word
    bias: float
    prior: float


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gathered(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of the rows one after the other, which row each belongs to)."""
    size = (ends - starts)[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    return flat[np.arange(len(owner)) + (starts[rows] - np.cumsum(size) + size)[owner]], owner


def negative_risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The logistic risk of the negatives: that of unlabelled text less the positives' share in it."""
    return float(_softplus(fu).mean() - prior * _softplus(fp).mean())


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The non-negative risk of scores on positives and unlabelled text."""
    return prior * float(_softplus(-fp).mean()) + max(0.0, negative_risk(fp, fu, prior))


def risk_gradient(fp: np.ndarray, fu: np.ndarray, prior: float) -> np.ndarray:
    """The step direction by score, positives first: the risk's gradient, or a step back on the negative part below zero."""
    if negative_risk(fp, fu, prior) >= 0:
        return np.concatenate([prior * (-_sigmoid(-fp) - _sigmoid(fp)) / len(fp), _sigmoid(fu) / len(fu)])
    return np.concatenate([prior * _sigmoid(fp) / len(fp), -_sigmoid(fu) / len(fu)])


def train_nnpu(words: np.ndarray, ends: np.ndarray, n_pos: int, prior: float, seed: int = 5) -> tuple[np.ndarray, float]:
    """(weights, bias); Adam with a pull of small weights to zero.

    words: the hashed words of all documents one after the other, the n_pos positives first;
    ends: where each document ends. Where there are enough positives every fifth is set aside.
    """
    rng = np.random.default_rng(seed)
    common = np.bincount(words, minlength=1 << BITS) >= LEAST_DOCS
    kept = common[words]
    ends = np.concatenate([[0], np.cumsum(kept)])[ends]
    starts = np.concatenate([[0], ends[:-1]])
    flat = (np.cumsum(common) - 1).astype(np.int32)[words[kept]]
    del words, kept
    n_unlabelled = len(ends) - n_pos
    n_words = max(1, int(common.sum()))
    w, b = np.zeros(n_words + 1), n_words  # the last one is the bias
    w[b] = np.log(prior / (1 - prior))
    first, second, step = np.zeros(n_words + 1), np.zeros(n_words + 1), 0
    half = min(BATCH, len(ends))
    aside = np.arange(n_pos) % ASIDE == ASIDE - 1 if n_pos >= 10 * ASIDE else np.zeros(n_pos, bool)
    learns = np.flatnonzero(~aside)

    for _ in range(EPOCHS):
        order = rng.permutation(n_unlabelled) + n_pos
        for s in range(0, len(order), half):
            u = order[s : s + half]
            p = rng.choice(learns, min(half, len(learns)), replace=False)
            rows = np.concatenate([p, u])
            ids, owner = gathered(flat, starts, ends, rows)
            f = w[b] + np.bincount(owner, w[ids], len(rows))
            fp, fu = f[: len(p)], f[len(p) :]
            g = risk_gradient(fp, fu, prior)
            grad = np.bincount(ids, g[owner], n_words + 1)
            grad[b] = g.sum()
            step += 1
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            rate = RATE / (np.sqrt(second / (1 - 0.99**step)) + 1e-5)
            moved = w - rate * first / (1 - 0.9**step)
            pull = rate * SPARSE
            pull[b] = 0.0
            w = np.sign(moved) * np.maximum(0, np.abs(moved) - pull)
    # The pull shrinks scores, so the bias is raised until nearly all positives that were set aside
    # are at 0.5 or above, but hardly more of the unlabelled text than the prior's share.
    owner = np.repeat(np.arange(len(ends)), ends - starts)
    f = w[b] + np.bincount(owner, w[flat], len(ends))
    if n_pos and n_unlabelled:
        judged = f[:n_pos][aside] if aside.any() else f[:n_pos]
        w[b] += min(max(0.0, -np.quantile(judged, MISSED)), -np.quantile(f[n_pos:], max(0.0, 1 - prior - SPARE)))
    out = np.zeros(1 << BITS)
    out[common] = w[: int(common.sum())]
    return out, float(w[-1])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn_from: Callable[[Column], Column] | None = None, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_words: int = MAX_WORDS) -> ToxicityModel:
    """labels: (id, label 0 or 1). learn_from: over the id, the rows whose label may be seen.

    Only positive labels train. prior is the share of toxic documents; by default the share among
    the labels that may be seen. Null labels and ids are not used. At most max_positive labelled
    and max_unlabelled other ids train, with max_words different words of a text; which ones,
    where there are more, is decided by hash, ties by id. Equal rows train once, and no more rows
    than ids may, whatever number of rows an id has. Without a positive label, or
    with an empty table, the model scores 0 everywhere. Columns of any name are fine.
    """
    allowed = labels.where(learn_from(F.col(id_col))) if learn_from is not None else labels
    known = allowed.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("__label"))
    share = known.agg(F.avg("__label").alias("share")).first()["share"]
    if not share:
        return ToxicityModel(spark.sparkContext.broadcast(np.zeros(1 << BITS)), -40.0, 0.0)
    prior = float(np.clip(share if prior is None else prior, 1e-4, 0.9))
    # Both samples are bounded lists of ids, so every task can have them.
    chance = F.xxhash64("__id", F.lit("toxic"))
    positive = known.where("__label > 0").orderBy(chance, "__id").limit(max_positive).select("__id", F.lit(True).alias("__positive"))
    pool = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"))
    pool = pool.where(learn_from(F.col("__id"))) if learn_from is not None else pool
    unlabelled = pool.orderBy(chance, "__id").limit(max_unlabelled).select("__id", F.lit(False).alias("__positive")).distinct()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    rows = source.join(F.broadcast(positive.union(unlabelled)), F.col("id") == F.col("__id")).select("id", F.col("__positive").alias("positive"), "body")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc, word = word_sets(list(pdf["body"]))
            cut = np.searchsorted(doc, np.arange(len(pdf) + 1))
            yield pd.DataFrame({"id": pdf["id"], "positive": pdf["positive"], "words": [_few(word[cut[i] : cut[i + 1]], max_words).astype("<i4").tobytes() for i in range(len(pdf))]})

    # An id that is repeated very often must not fill the driver.
    lists = rows.mapInPandas(listed, "id long, positive boolean, words binary").dropDuplicates()
    got = lists.orderBy(F.xxhash64("id", "words"), "id").limit(max_positive + max_unlabelled).toPandas()
    got = got.iloc[np.lexsort([got["words"].map(zlib.crc32), textnum.mix(got["id"].to_numpy(np.int64).view(np.uint64)), ~got["positive"].to_numpy(bool)])]
    ends, n_pos = np.cumsum(got["words"].map(len).to_numpy(np.int64) // 4), int(got["positive"].sum())
    words = np.frombuffer(b"".join(got["words"]), "<i4")
    del got
    weights, bias = train_nnpu(words, ends, n_pos, prior)
    return ToxicityModel(spark.sparkContext.broadcast(weights), bias, prior)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of docs with score, the probability that the text is toxic.

    Null text is scored as empty. Very long texts are read whole. Repeated rows, and rows with
    null ids, get the score of their text; an empty table gives no rows. A column that is called
    score_col already is replaced.
    """
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def scored(body: pd.Series) -> pd.Series:
        doc, word = word_sets(list(body))
        return pd.Series(_sigmoid(bias + np.bincount(doc, weights.value[word], len(body))))

    return docs.withColumn(score_col, scored(F.col(text_col).cast("binary")))
