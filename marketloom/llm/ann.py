"""Operator 10: nearest neighbours by stable projections and incremental search (SRS).

Vectors are projected to ``DIMENSIONS`` numbers by a Gaussian (2-stable) matrix; for two vectors at
distance d the squared projected distance is d^2 times a chi-square variable.  Every block of vectors
has a kd-tree over its projections.  A query visits its neighbours in the projected space in order
of distance, verifies each on the original vector, and stops when the chi-square test says that an
unseen vector nearer than the k-th best would by now have been seen with probability ``CONFIDENCE``
(Sun et al., "SRS: Solving c-Approximate Nearest Neighbor Queries with a Tiny Index", 2014).

All rows are indexed.  Queries meet every block; per block they are streamed in the order of their
id and the block's tree stays in memory, so a task holds one block and one batch of queries.

Vectors that are null, empty, zero, or hold null or non-finite components take no part; so do vectors of
another length than the query's.  Rows that repeat a vec_id are candidates each, and as queries
each is answered, with all other rows of its id left out.  Ties go to the
smaller vec_id.  A null vec_id takes no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

DIMENSIONS = 8
CONFIDENCE = 0.97
BLOCK_ROWS = 16_384
LEAF = 32


def chi_square_cdf(x: np.ndarray, m: int = DIMENSIONS) -> np.ndarray:
    """P(chi-square with an even number m of degrees <= x)."""
    h = np.minimum(np.asarray(x, float) / 2, 700.0)
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, m // 2):
        term = term * h / i
        total += term
    return 1 - np.exp(-h) * total


def chi_square_quantile(p: float, m: int = DIMENSIONS) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, m) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


def projection(dim: int, m: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(1000 + dim).normal(size=(dim, m))


class Tree:
    """kd-tree leaves over projected points: contiguous runs with bounding boxes."""

    def __init__(self, points: np.ndarray):
        self.order = np.empty(len(points), np.int64)
        spans: list[tuple[int, int]] = []
        stack = [(np.arange(len(points)), 0)]
        while stack:
            at, start = stack.pop()
            if len(at) <= LEAF:
                self.order[start : start + len(at)] = at
                spans.append((start, start + len(at)))
                continue
            wide = int(np.argmax(np.ptp(points[at], axis=0)))
            half = len(at) // 2
            split = np.argpartition(points[at, wide], half)
            stack.append((at[split[half:]], start + half))
            stack.append((at[split[:half]], start))
        self.spans = np.array(spans)
        self.points = points[self.order]
        self.low = np.array([self.points[a:b].min(axis=0) for a, b in spans])
        self.high = np.array([self.points[a:b].max(axis=0) for a, b in spans])

    def nearest(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Positions in growing projected distance, in runs, each with the distance all later ones reach."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        reach = (gap**2).sum(axis=1)
        leaves = np.argsort(reach, kind="stable")
        step, wait, waits = 8, np.empty(0, np.int64), np.empty(0)
        for s in range(0, len(leaves), step):
            at = np.concatenate([np.arange(*self.spans[x]) for x in leaves[s : s + step]])
            wait = np.concatenate([wait, at])
            waits = np.concatenate([waits, ((self.points[at] - q) ** 2).sum(axis=1)])
            bound = reach[leaves[s + step]] if s + step < len(leaves) else math.inf
            ready = waits <= bound
            if ready.any():
                yield self.order[wait[ready][np.argsort(waits[ready], kind="stable")]], float(bound)
                wait, waits = wait[~ready], waits[~ready]


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, q: np.ndarray, q_id: int, k: int, stop: float):
    """The k nearest found: distances and ids, by (distance, id)."""
    best_d, best_i = np.empty(0), np.empty(0, np.int64)
    pq = q @ projection(len(q))
    for at, bound in tree.nearest(pq):
        at = at[ids[at] != q_id]
        d = np.sqrt(((vectors[at] - q) ** 2).sum(axis=1))
        d, i = np.concatenate([best_d, d]), np.concatenate([best_i, ids[at]])
        keep = np.lexsort((i, d))[:k]
        best_d, best_i = d[keep], i[keep]
        if len(best_d) == k and bound > stop * best_d[-1] ** 2:
            break
    return best_d, best_i


def usable(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    good = (
        F.col("vec_id").isNotNull()
        & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    )
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where(good)


def _answer(k: int):
    stop = chi_square_quantile(CONFIDENCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, trees = None, [], {}
        for batch in batches:
            df = batch.to_pandas()
            out_u, out_q, out_v, out_d = [], [], [], []
            for (b, query), g in df.groupby(["block", "query"], sort=False):
                if b != block:
                    block, rows, trees = b, [], None
                if not query:
                    rows.append(g[["vec_id", "embedding"]])
                    continue
                if trees is None:
                    trees = _trees(rows)
                    rows = []
                for uid, q_id, x in zip(g["uid"], g["vec_id"], g["embedding"], strict=True):
                    q = np.asarray(x, float)
                    if len(q) in trees:
                        tree, vectors, ids = trees[len(q)]
                        d, i = search(tree, vectors, ids, q, q_id, k, stop)
                        out_u += [uid] * len(d)
                        out_q += [q_id] * len(d)
                        out_v.append(i)
                        out_d.append(d)
            if out_q:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_u, pa.int64()), pa.array(out_q, pa.int64()), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_d))],
                    names=["uid", "query_id", "vec_id", "score"],
                )

    return run


def _trees(rows: list[pd.DataFrame]) -> dict:
    """A tree by vector length over one block's rows."""
    if not rows:
        return {}
    df = pd.concat(rows, ignore_index=True)
    sizes = df["embedding"].map(len)
    out = {}
    for dim, g in df.groupby(sizes):
        vectors = np.stack([np.asarray(x, float) for x in g["embedding"]])
        out[dim] = (Tree(vectors @ projection(dim)), vectors, g["vec_id"].to_numpy(np.int64))
    return out


def neighbours(spark: SparkSession, vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score for every vec_id that ``every`` divides."""
    # written, so that a row keeps its number if a lost executor has it computed again
    rows = Scratch(spark, "ann").write("rows", usable(vectors).withColumn("uid", F.monotonically_increasing_id()))
    blocks = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    base = rows.select("uid", "vec_id", "embedding", F.lit(False).alias("query"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks).cast("long")).alias("block"))
    queries = rows.where(F.col("vec_id") % every == 0).select(
        "uid", "vec_id", "embedding", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    )
    found = (
        base.unionByName(queries)
        .repartition(blocks, "block")
        .sortWithinPartitions("block", "query", "vec_id")
        .mapInArrow(_answer(k), "uid long, query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("uid").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
