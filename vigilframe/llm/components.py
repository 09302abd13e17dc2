"""Connected components of an edge table, on Spark alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import discard, materialize

#: Edges that wait for a contraction; a bound on memory, not on results.
AT_ONCE = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that keep the components of edges (a, b)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        lu, lv = label[u], label[v]
        differ = lu != lv
        if not differ.any():
            break
        u, v, lu, lv = u[differ], v[differ], lu[differ], lv[differ]
        np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
        while True:  # every node points at its root
            up = label[label]
            if (up == label).all():
                break
            label = up
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of the task's edges; edges wait until there are about as many as it has."""
    a = b = np.empty(0, np.int64)
    more_a, more_b, waiting = [], [], 0
    for pdf in batches:
        more_a.append(pdf["src"].to_numpy(np.int64))
        more_b.append(pdf["dst"].to_numpy(np.int64))
        waiting += len(pdf)
        if waiting > AT_ONCE + len(a):
            a, b = forest(np.concatenate([a, *more_a]), np.concatenate([b, *more_b]))
            more_a, more_b, waiting = [], [], 0
    a, b = forest(np.concatenate([a, *more_a]), np.concatenate([b, *more_b]))
    yield pd.DataFrame({"src": a, "dst": b})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (src, dst); label is the smallest node reachable.

    Alternates two steps until nothing changes: every node links its larger neighbours to its
    smallest neighbour, then its smaller neighbours to the smallest. Both are a min and a join,
    so a node with very many neighbours is combined before the shuffle. Null ends are dropped;
    loops, repeated edges and an empty table are fine.
    """
    pairs = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null and src <> dst")
    now = materialize(pairs.mapInPandas(_contract, "src long, dst long"), "components", "none")
    seen = None
    while True:
        # Edges run from the larger node (src) to the smaller (dst).
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
        lower = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(lower, "src")
        small = small.select("src", F.col("low").alias("dst")).union(small.where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))).distinct()
        before, now = now, materialize(small, "components", "none")
        discard(before)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return now.select(F.col("src").alias("node"), F.col("dst").alias("label")).union(now.select("dst", "dst").distinct()).distinct()
