"""Operator 3: near-duplicate embeddings by randomised-rotation binary codes (RaBitQ).

A unit vector is rotated at random and stored as its signs and a correction factor, which make the inner
product of the code with another rotated vector an unbiased estimate of the cosine (Gao & Long, "RaBitQ",
2024).  The other side is stored too, rounded at random to a byte a component, so that estimates need no
vector.  Their error is bounded with high confidence, and the bound says which pairs might link; those,
and only those, are recomputed on the original vectors in double precision.  Pairs are looked for inside
the buckets of random-hyperplane sign bits, in so many tables that a pair at the threshold shares no
bucket with probability ``MISS``.

Two passes go over the buckets.  The first moves codes and returns the members that have a pair in doubt;
the second moves the vectors of those members alone and recomputes their pairs in doubt.  Equal vectors
of one label are one class from the start.  No pair leaves a task: a bucket returns for each of its vectors
how many links it has there (a pair counts in the first table it shares), and the smallest vector its links
reach.  Buckets larger than ``BLOCK`` are compared block by block.

Vectors that are null, empty, zero or hold null or non-finite components, or whose label or vec_id is null,
link with nothing: n_links 0, component_id their own vec_id.  Vectors of different length have no
cosine and do not link.  Rows that repeat a vec_id count as vectors each.  An empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected, group_runs, map_arrow

COSINE = 0.98
MISS = 1e-6
#: Standard deviations of the estimate that the confidence bound allows.
CONFIDENCE = 5.0
BLOCK = 1024
#: Groups up to this size are compared together, row against row; larger ones by matrix product.
SMALL = 48
#: Numbers that one step over pairs holds at once.
STEP = 1 << 22


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(300 + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def hyperplanes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(7000 + dim).normal(size=(dim, count))


_drawn: dict[tuple, np.ndarray] = {}


def drawn(make, *args) -> np.ndarray:
    """A random matrix, drawn once a worker."""
    if (make, args) not in _drawn:
        _drawn[make, args] = make(*args)
    return _drawn[make, args]


def plan(rows: int) -> tuple[int, int]:
    """Bits of a bucket key, growing with the logarithm of the rows, and tables that bring MISS."""
    bits = min(max(8, math.ceil(math.log2(max(rows, 2)))), 31)
    same = (1 - math.acos(COSINE) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, their signs (+1, -1) and the factors <code, vector> that correct estimates."""
    turned = unit @ drawn(rotation, unit.shape[1])
    return turned, np.where(turned >= 0, 1.0, -1.0), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def rounded(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors as bytes, lows and steps: low + step * byte, rounded up or down at random, unbiased."""
    low = turned.min(axis=1)
    step = (turned.max(axis=1) - low) / 255
    up = np.random.default_rng(500 + turned.shape[1]).random(turned.shape[1])
    scaled = (turned - low[:, None]) / np.where(step > 0, step, 1.0)[:, None]
    return np.clip(np.floor(scaled + up), 0, 255).astype(np.uint8), low, step


def estimates(dots, sums, factors, lows, steps, dim: int):
    """Unbiased cosines from the products of signs with bytes, the sums of signs and the stored numbers."""
    return (lows * sums + steps * dots) / (math.sqrt(dim) * factors)


def floors(factors, steps, dim: int):
    """The smallest estimate that a pair at the threshold can have, within the confidence bound."""
    spread = np.sqrt(np.maximum(1 - factors**2, 0)) / math.sqrt(max(dim - 1, 1))
    off = np.hypot(math.sqrt(1 - COSINE**2) * spread, steps / 2) / factors
    return COSINE - CONFIDENCE * off - 1e-9


_CODED = (
    "cid long, rep long, copies long, label string, dim int, code binary, bytes binary, "
    "factor double, low double, step double, keys array<int>, vector binary"
)


def _codes(bits: int, tables: int):
    def rows(columns: dict) -> dict:
        lists = columns["embedding"]
        values = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        out = {k: [None] * len(sizes) for k in ("code", "bytes", "factor", "low", "step", "keys", "vector")}
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            x = values[starts[at][:, None] + np.arange(dim)]
            # by a power of two, which changes no cosine
            x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
            turned, signs, factors = codes(x / np.sqrt((x * x).sum(axis=1))[:, None])
            whole, low, step = rounded(turned)
            planes = drawn(hyperplanes, dim, bits * tables)
            powers = 1 << np.arange(bits, dtype=np.int64)
            keys = np.stack([(x @ planes[:, t * bits : (t + 1) * bits] > 0) @ powers for t in range(tables)], axis=1)
            packed = np.packbits(signs > 0, axis=1)
            for k, r in enumerate(at.tolist()):
                out["code"][r], out["bytes"][r] = packed[k].tobytes(), whole[k].tobytes()
                out["factor"][r], out["low"][r], out["step"][r] = factors[k], low[k], step[k]
                out["keys"][r], out["vector"][r] = keys[k].tolist(), x[k].astype("<f8").tobytes()
        return {k: columns[k] for k in ("cid", "rep", "copies", "label", "dim")} | out

    return rows


def reach(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each row reaches over the links (i, j)."""
    low = ids.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        if (new == low).all():
            return low
        low = new


def _within(group: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows ``at`` of equal group, where rows of a group stand together."""
    g = group[at]
    i, d = np.arange(len(at)), 1
    while True:
        i = i[i + d < len(at)]
        i = i[g[i] == g[i + d]]
        if not len(i):
            return
        yield at[i], at[i + d]
        d += 1


def _in_doubt(run: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a cell, in the first table that they share, which their codes can't tell apart."""
    n = run.num_rows
    sizes = np.diff(np.append(starts, n))
    group = np.repeat(np.arange(len(starts)), sizes)
    size = sizes[group]
    number = {k: run.column(k).to_numpy() for k in ("dim", "table", "one", "two", "block", "factor", "low", "step")}
    keys = run.column("keys").combine_chunks().flatten().to_numpy().reshape(n, -1)
    crossed = number["one"] != number["two"]
    for dim in np.unique(number["dim"]).tolist():
        of = np.flatnonzero((number["dim"] == dim) & (size > 1))
        if not len(of):
            continue
        place = np.full(n, -1)
        place[of] = np.arange(len(of))
        bits = np.frombuffer(b"".join(run.column("code").take(of).to_pylist()), np.uint8).reshape(len(of), -1)
        signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
        whole = np.frombuffer(b"".join(run.column("bytes").take(of).to_pylist()), np.uint8).reshape(len(of), dim).astype(np.float32)
        sums = signs.sum(axis=1)
        factor, low, step = (number[k][of] for k in ("factor", "low", "step"))

        def clear(a, b, dots):
            """Whether the code of a leaves b in doubt; a and b index rows of this dim and broadcast."""
            guess = estimates(dots, sums[a], factor[a], low[b], step[b], dim)
            return guess >= floors(factor[a], step[b], dim)

        def told(i, j):
            keep = ~crossed[i] | (number["block"][i] != number["block"][j])
            i, j = i[keep], j[keep]
            earlier = (keys[i] == keys[j]) & (np.arange(keys.shape[1])[None, :] < number["table"][i][:, None])
            first = ~earlier.any(axis=1)
            return i[first], j[first]

        part = max(1, STEP // max(dim, keys.shape[1]))
        for i, j in _within(group, of[size[of] <= SMALL]):
            for k in range(0, len(i), part):
                a, b = place[i[k : k + part]], place[j[k : k + part]]
                a, b = (x[clear(a, b, np.einsum("nd,nd->n", signs[a], whole[b]))] for x in (a, b))
                a, b = (x[clear(b, a, np.einsum("nd,nd->n", signs[b], whole[a]))] for x in (a, b))
                yield told(of[a], of[b])
        for g in np.flatnonzero(sizes > SMALL):
            if number["dim"][starts[g]] != dim:
                continue
            at = place[starts[g]] + np.arange(sizes[g])
            maybe = clear(at[:, None], at[None, :], signs[at] @ whole[at].T)
            i, j = np.nonzero(np.triu(maybe & maybe.T, 1))
            for k in range(0, len(i), part):
                yield told(of[at[i[k : k + part]]], of[at[j[k : k + part]]])


CELL = ["label", "dim", "table", "key", "one", "two"]
_MEMBER = "label string, dim int, table int, key int, one int, two int, block int, cid long"


def _doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of a cell that have a pair in doubt."""
    for run, starts in group_runs(batches, CELL):
        marked = np.zeros(run.num_rows, bool)
        for i, j in _in_doubt(run, starts):
            marked[i] = marked[j] = True
        if marked.any():
            yield from run.select([*CELL, "block", "cid"]).filter(pa.array(marked)).combine_chunks().to_batches()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per cell of a bucket: cid, links found there, rep, and the smallest rep its links reach."""
    for run, starts in group_runs(batches, CELL):
        n = run.num_rows
        vectors, copies = run.column("vector"), run.column("copies").to_numpy()
        cid, rep = run.column("cid").to_numpy(), run.column("rep").to_numpy()
        ends, others = [], []
        for i, j in _in_doubt(run, starts):
            if not len(i):
                continue
            # rows of one call have one dim
            rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            x = np.frombuffer(b"".join(vectors.take(rows).to_pylist()), "<f8").reshape(len(rows), -1)
            length = np.sqrt((x * x).sum(axis=1))
            a, b = at[: len(i)], at[len(i) :]
            exact = np.einsum("nd,nd->n", x[a], x[b]) / (length[a] * length[b]) >= COSINE
            ends.append(i[exact])
            others.append(j[exact])
        if not ends:
            continue
        i, j = np.concatenate(ends), np.concatenate(others)
        links = (np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)).astype(np.int64)
        to = reach(i, j, rep)
        at = np.flatnonzero(links)
        if len(at):
            yield pa.RecordBatch.from_pydict({"cid": cid[at], "links": links[at], "rep": rep[at], "to": to[at]})


def near_duplicates(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """Per row of vectors(vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    scratch = Scratch(spark, "embeddings")
    x = F.col("embedding")
    good = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    )
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("string").alias("label"),
    ).withColumn("good", good)
    classes = scratch.write(
        "classes",
        rows.where("good")
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("cid", F.monotonically_increasing_id())
        .withColumn("dim", F.size("embedding")),
    )
    bits, tables = plan(classes.count())
    coded = scratch.write("coded", map_arrow(classes, _codes(bits, tables), _CODED))
    bucket = ["label", "dim", "table", "key"]
    entries = coded.select("label", "dim", "cid", F.posexplode("keys").alias("table", "key"))
    shared = entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = (
        entries.join(shared, bucket)
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*bucket, "cid", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    )

    def cells(of: DataFrame, *columns: str) -> DataFrame:
        stored = coded.select("cid", "code", "bytes", "factor", "low", "step", "keys", *columns)
        return of.join(stored, "cid").repartition(*CELL).sortWithinPartitions(*CELL)

    doubtful = scratch.write("doubtful", cells(members).mapInArrow(_doubtful, _MEMBER))
    found = scratch.write(
        "found",
        cells(doubtful, "rep", "copies", "vector").mapInArrow(_links, "cid long, links long, rep long, to long"),
    )
    components = connected(scratch, found.select(F.col("rep").alias("u"), F.col("to").alias("v")), "cc")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    by_class = (
        classes.join(links, "cid", "left")
        .join(components.select(F.col("node").alias("rep"), F.col("label").alias("smallest")), "rep", "left")
        .select(
            "label",
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("smallest", "rep").alias("component"),
        )
    )
    joined = rows.where("good").join(by_class, ["label", "embedding"]).select("vec_id", "n_links", "component")
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return joined.union(alone).select(
        "vec_id",
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("component") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
