"""Near-dedup of embeddings with randomised-rotation binary codes.

A vector is rotated at random and stored as its signs, with the inner product of the vector and
its sign code as a correction factor, and as a coarse copy of the rotated vector, four bits a
component with random rounding. One vector's code times the other's coarse copy over the factor
estimates their cosine without bias, and factor and step bound its error. Codes alone travel to
the buckets where vectors meet; the vectors themselves follow only for those that have a pair
whose bound reaches the threshold, and just such pairs are computed again in double precision.
Which pairs meet is decided by pieces of several sign codes; there are enough of them that a
pair at the threshold is missed with probability MISS at most, and closer pairs far less often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm import textnum
from vigilframe.llm.common import discard, materialize
from vigilframe.llm.components import connected_components, forest

#: Chance that a pair exactly at the threshold shares no bucket.
MISS = 1e-4
#: Standard errors of the estimate that the bound allows for.
SIGMAS = 5.5
#: Vectors that share a bucket on average, and most that meet in one block of a task.
PER_BUCKET, BLOCK = 1000, 4096


@lru_cache(maxsize=64)
def rotation(dim: int, nth: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([dim, nth, 90125]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def tables_for(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a bucket, number of tables) for n vectors."""
    bits = min(30, max(4, round(math.log2(max(2.0, n / PER_BUCKET)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-agree)))


def _buckets(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables): the bucket of each vector in each table."""
    dim = unit.shape[1]
    signs = [unit @ rotation(dim, k) > 0 for k in range(-(-bits * tables // dim))]
    flat = np.concatenate(signs, axis=1)[:, : bits * tables].reshape(len(unit), tables, bits)
    return (flat * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def encoded(unit: np.ndarray, salt: np.ndarray) -> pd.DataFrame:
    """code (packed signs), factor, coarse (two components a byte), low and step of unit vectors."""
    dim = unit.shape[1]
    turned = unit @ rotation(dim, 0)
    factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / 15, 1e-300)
    # Rounded up or down at random, by a hash that depends on the vector and the component alone.
    chance = textnum.mix(salt.astype(np.int64).view(np.uint64)[:, None] * np.uint64(dim) + np.arange(dim, dtype=np.uint64)) >> np.uint64(11)
    coarse = np.clip(np.floor((turned - low[:, None]) / step[:, None] + chance / 2.0**53), 0, 15).astype(np.uint8)
    coarse = np.pad(coarse, ((0, 0), (0, dim % 2)))
    return pd.DataFrame({
        "code": [c.tobytes() for c in np.packbits(turned > 0, axis=1)], "factor": factor,
        "coarse": [c.tobytes() for c in coarse[:, ::2] << 4 | coarse[:, 1::2]], "low": low, "step": step,
    })


def estimate(mine: pd.DataFrame, other: pd.DataFrame, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of all pairs by the codes of mine and the coarse copies of other, and the least estimate that may reach threshold."""
    signs = np.unpackbits(np.stack([np.frombuffer(c, np.uint8) for c in mine["code"]]), axis=1)[:, :dim]
    code = (signs.astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    pairs = np.stack([np.frombuffer(c, np.uint8) for c in other["coarse"]])
    coarse = np.stack([pairs >> 4, pairs & 15], axis=2).reshape(len(pairs), -1)[:, :dim].astype(np.float32)
    factor, step, low = mine["factor"].to_numpy()[:, None], other["step"].to_numpy()[None, :], other["low"].to_numpy()[None, :]
    guess = (code @ coarse.T * step + code.sum(axis=1)[:, None] * low) / factor
    code_error = math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1))
    step_error = 0.5 * step / factor  # a rounding is off by half a step at most in the mean square
    return guess, threshold - SIGMAS * np.sqrt(code_error**2 + step_error**2) - 1e-5


def _candidates(a: pd.DataFrame, b: pd.DataFrame | None, dim: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a and b (within a if b is None) whose bound reaches the threshold, some rows at a time."""
    for at in range(0, len(a), 512):
        guess, least = estimate(a.iloc[at : at + 512], a if b is None else b, dim, threshold)
        i, j = np.nonzero(guess >= least)
        i = i + at
        yield (i[j > i], j[j > i]) if b is None else (i, j)


def _halves(pdf: pd.DataFrame, i: int, j: int) -> tuple[pd.DataFrame, pd.DataFrame | None]:
    return (pdf, None) if i == j else (pdf[pdf["own"] == i], pdf[pdf["own"] == j])


def _blocks_links(a: pd.DataFrame, b: pd.DataFrame | None, dim: int, threshold: float, nth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between rows of a and b that no earlier table shows."""
    other = a if b is None else b
    ua, ub = (np.stack([np.frombuffer(v, "<f8") for v in x["v"]]) for x in (a, other))
    ka, kb = (np.stack(x["buckets"].to_list())[:, :nth] for x in (a, other))
    rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in _candidates(a, b, dim, threshold):
        for s in range(0, len(i), 1 << 17):
            p, q = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
            near = np.einsum("ij,ij->i", ua[p], ub[q]) >= threshold
            p, q = p[near], q[near]
            fresh = ~(ka[p] == kb[q]).any(axis=1)
            rows.append(p[fresh])
            cols.append(q[fresh])
    i, j = np.concatenate(rows), np.concatenate(cols)
    return a["cls"].to_numpy()[i], other["cls"].to_numpy()[j], a["m"].to_numpy()[i], other["m"].to_numpy()[j]


CODES = ["cls", "m", "dim", "code", "factor", "coarse", "low", "step", "v", "buckets"]
MEETING = ["dim", "nth", "bucket", "i", "j"]


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    n_links counts the other rows at a cosine of threshold or more; component_id is the smallest
    id reachable. Null, empty and zero vectors and those with null or non-finite components link
    with nothing, as do vectors of different length. Equal vectors are compared once and count
    each. A null id counts as a row; its component is the smallest other id reachable, or null.
    An empty table gives no rows. Other columns are ignored.
    """
    e = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.coalesce(
        (F.size(e) > 0) & F.forall(e, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
        & F.exists(e, lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(good, e).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("low"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "vec-classes")
    bits, tables = tables_for(classes.count(), threshold)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["v"].map(len)
            for _, part in pdf.groupby(size):
                x = np.stack(part["v"].to_list())
                # Scaled first: the square of a large component may not be finite.
                x = x / np.abs(x).max(axis=1, keepdims=True)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                cls = part["cls"].to_numpy()
                yield encoded(unit, cls).assign(cls=cls, m=part["m"].to_numpy(), dim=unit.shape[1], v=[u.astype("<f8").tobytes() for u in unit], buckets=list(_buckets(unit, bits, tables)))[CODES]

    codes = materialize(classes.select("cls", "m", "v").mapInPandas(coded, "cls long, m long, dim int, code binary, factor double, coarse binary, low double, step double, v binary, buckets array<int>"), "vec-codes")
    meets = codes.select("dim", F.posexplode("buckets").alias("nth", "bucket"), "cls", "code", F.col("factor").cast("float"), "coarse", F.col("low").cast("float"), F.col("step").cast("float"))
    full = meets.groupBy("dim", "nth", "bucket").count().where(F.col("count") > BLOCK).select("dim", "nth", "bucket", F.ceil(F.col("count") / BLOCK).alias("parts"))
    dealt = meets.join(materialize(full, "vec-full"), ["dim", "nth", "bucket"], "left")
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")))
    # In a full bucket every two parts meet once; a row goes to each meeting of its part.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("parts", "other")

    def wanted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows of a meeting that have a pair to compute again."""
        dim, nth, bucket, i, j = map(int, key)
        a, b = _halves(pdf, i, j)
        if len(a) < 2 and b is None or b is not None and not (len(a) and len(b)):
            a = a.iloc[:0]
        left, right = np.zeros(len(a), bool), np.zeros(len(a if b is None else b), bool)
        for p, q in _candidates(a, b, dim, threshold) if len(a) else ():
            left[p], right[q] = True, True
        rows = a[left | right] if b is None else pd.concat([a[left], b[right]])
        return pd.DataFrame({"dim": dim, "nth": nth, "bucket": bucket, "i": i, "j": j, "own": rows["own"].to_numpy(), "cls": rows["cls"].to_numpy()})

    asked = materialize(dealt.groupBy(*MEETING).applyInPandas(wanted, "dim int, nth int, bucket int, i long, j long, own long, cls long"), "vec-wanted")

    def compared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, ma, mb = _blocks_links(*_halves(pdf, int(key[3]), int(key[4])), int(key[0]), threshold, int(key[1]))
        node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        links = np.bincount(at, np.concatenate([mb, ma]), len(node)).astype(np.int64)
        fa, fb = forest(a, b)
        return pd.DataFrame({"cls": np.concatenate([node, fa]), "links": np.concatenate([links, np.zeros(len(fa), np.int64)]), "to": pd.array([pd.NA] * len(node) + fb.tolist(), "Int64")})

    found = asked.join(codes.select("cls", "m", "code", "factor", "coarse", "low", "step", "v", "buckets"), "cls").groupBy(*MEETING).applyInPandas(compared, "cls long, links long, to long")
    found = materialize(found, "vec-links")
    discard(codes, asked)
    links = found.where("to is null").groupBy("cls").agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("to is not null").select(F.col("cls").alias("src"), F.col("to").alias("dst"))).withColumnRenamed("node", "cls")
    named = classes.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    lowest = materialize(named.groupBy("label").agg(F.min("low").alias("component_id")), "vec-lowest")
    named = named.join(lowest, "label").join(links, "cls", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = rows.join(named, "v", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
