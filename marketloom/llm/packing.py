"""Operator 9: pack documents into fixed-length sequences along a space-filling curve.

A document's token counts, hashed into a small vector, are projected to three dimensions; the
projected point's Hilbert key orders the documents so that similar ones stand next to each other.
Token streams are laid end to end in that order and cut every ``SEQUENCE`` tokens, so sequences
hold neighbours of the curve and only the last one of all needs padding.

Ids are encoded once and kept in a scratch table; ordering moves only keys and lengths.  Range
partitions sort (key, doc_id, row), so a key that many equal documents share is split as well; each
partition's first position is the sum of those before it, one number for each partition.

Nulls: a null text is empty, its document is the end token alone.  A null doc_id is kept as null.
Repeated rows are packed once each.  An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, partitions
from .tokenizing import rank_vocabulary

SEQUENCE = 2048
END_ID = 1
#: Hash buckets of a document's token counts, and dimensions and bits of the curve.
BUCKETS = 64
DIMENSIONS = 3
CURVE_BITS = 16


@lru_cache
def _projection() -> np.ndarray:
    return np.random.default_rng(9).normal(size=(BUCKETS, DIMENSIONS))


def hilbert_keys(points: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Hilbert index of integer points [n, d], each coordinate in [0, 2**bits) (Skilling 2004)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = np.int64(1) << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            x[0] = np.where(on, x[0] ^ low, x[0])
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = np.int64(1) << (bits - 1)
    while q > 1:
        flip = np.where((x[d - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Keys of count vectors [n, BUCKETS]: unit length, projected, squashed to the curve's grid."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(length == 0, 1, length)
    at = 1 / (1 + np.exp(-2 * (unit @ _projection())))
    return hilbert_keys(np.minimum((at * 2**CURVE_BITS).astype(np.int64), 2**CURVE_BITS - 1))


def _encoder(vocabulary: tuple[str, str]):
    def rows(columns: dict) -> dict:
        memo = rank_vocabulary(*vocabulary)
        squeeze = zstandard.ZstdCompressor(level=1)
        out = {"key": [], "n": [], "ids": []}
        vectors = []
        for text in columns["text"].to_pylist():
            packed = memo.packed(text) if text else b""
            ids = np.frombuffer(packed, memo.dtype)
            # a multiplicative hash deals ids to buckets
            bucket = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(26)
            vectors.append(np.bincount(bucket, minlength=BUCKETS))
            out["n"].append(len(ids) + 1)
            out["ids"].append(squeeze.compress(packed))
        out["key"] = curve_keys(np.array(vectors, float)).tolist()
        return out | {"doc_id": columns["doc_id"]}

    return rows


def _places(batches):
    """Running start of each row within its sorted partition."""
    at = 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), batch.column("part"), batch.column("n"), pa.array(ends - n)],
            names=["uid", "part", "n", "start"],
        )
        if len(n):
            at = int(ends[-1])


def _cutter(vocabulary: tuple[str, str]):
    def rows(columns: dict) -> dict:
        dtype = rank_vocabulary(*vocabulary).dtype
        expand = zstandard.ZstdDecompressor()
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        out = {k: [] for k in names}
        for doc_id, n, packed, place in zip(
            *(columns[c].to_pylist() for c in ("doc_id", "n", "ids", "place")), strict=True
        ):
            ids = np.append(np.frombuffer(expand.decompress(packed), dtype), END_ID).astype("<u4")
            done = 0
            while done < n:
                sequence, offset = divmod(place + done, SEQUENCE)
                length = min(n - done, SEQUENCE - offset)
                for name, value in zip(
                    names,
                    (doc_id, done, length, zlib.crc32(ids[done : done + length].tobytes()), n, sequence, offset),
                    strict=True,
                ):
                    out[name].append(value)
                done += length
        return out

    return rows


def pack(spark: SparkSession, docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``vocabulary`` names the rank file and the tokenizer's JSON file, whose added tokens keep their own ids.
    """
    vocabulary = vocabulary or (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = scratch.write(
        "tokens",
        map_arrow(docs, _encoder(vocabulary), "doc_id long, key long, n long, ids binary").withColumn(
            "uid", F.monotonically_increasing_id()
        ),
    )
    ordered = (
        tokens.select("key", "doc_id", "uid", "n")
        .repartitionByRange(partitions(spark), "key", "doc_id", "uid")
        .sortWithinPartitions("key", "doc_id", "uid")
        .select("uid", "n", F.spark_partition_id().alias("part"))
        .mapInArrow(_places, "uid long, part int, n long, start long")
    )
    ordered = scratch.write("ordered", ordered)
    totals = ordered.groupBy("part").agg(F.sum("n").alias("n"))
    # one row for each range partition, so the window over all of them is small
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    places = ordered.join(F.broadcast(bases), "part").select("uid", (F.col("base") + F.col("start")).alias("place"))
    pieces = tokens.select("uid", "doc_id", "n", "ids").join(places, "uid")
    return map_arrow(
        pieces.select("doc_id", "n", "ids", "place"),
        _cutter(vocabulary),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
