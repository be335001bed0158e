"""Operator 5: quality scores by naive Bayes support vectors (NBSVM).

A document becomes a set of n-gram indicators: its lower-cased words, and one to three neighbouring
word shapes (case, digits, punctuation kept as signs, and whether a word repeats the one before).
Indicators are hashed to ``FEATURES`` columns and scaled by the class log-count ratio; a linear
hinge-loss model is fitted to the scaled, length-normalised rows by dual coordinate descent, and its
margins become probabilities by a logistic fit on rows kept out of the descent.

The model is fitted on at most ``TRAIN_ROWS`` labelled documents, chosen by a hash of doc_id among
those whose crc32(doc_id) mod 5 is not 0; nothing but text is an input of a score.

Nulls: a null or blank text has no feature and gets the score of the model's bias; a null doc_id is
never a training row and counts as held_out false.  A doc_id with contradicting labels is left out.
With no labelled row the score is 0.5; with one class only it is that class's smoothed share.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow
from .memo import claim

FEATURES = 1 << 18
#: Bound of the labelled sample that the model is fitted on.
TRAIN_ROWS = 12_000
THRESHOLD = 0.3
MEMO_WORDS = 250_000
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12

_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    """``Ndrein$$$`` -> ``Aa$``: letters by case, digits as 9, every other sign once per run."""
    s = _DIGIT.sub("9", word)
    s = "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in s)
    return re.sub(r"(.)\1+", r"\1", s)


class _Words(dict):
    """word -> hash of its lower case in the high 32 bits, hash of its shape in the low 32."""

    def __missing__(self, word: str) -> int:
        value = (xxhash.xxh32_intdigest(word.lower().encode("utf-8", "surrogatepass")) << 32) | (
            xxhash.xxh32_intdigest(shape(word).encode("utf-8", "surrogatepass"))
        )
        if len(self) < MEMO_WORDS and len(word) <= 64:
            self[word] = value
        return value


_words = _Words()
_MASK = np.uint64(FEATURES - 1)


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) & _MASK).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Distinct feature columns of a text."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int64)
    claim(_words)
    both = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    word = both >> np.uint64(32)
    sign = (both & np.uint64(0xFFFFFFFF)) << np.uint64(1)
    sign[1:] |= (word[1:] == word[:-1]).astype(np.uint64)
    parts = [_slot(word, 1), _slot(sign, 2)]
    if len(words) > 1:
        pair = sign[:-1] * np.uint64(0x100000001B3) + sign[1:]
        parts.append(_slot(pair, 3))
        if len(words) > 2:
            parts.append(_slot(pair[:-1] * np.uint64(0x100000001B3) + sign[2:], 4))
    seen = np.zeros(FEATURES, bool)
    seen[np.concatenate(parts)] = True
    return np.flatnonzero(seen)


class Nbsvm:
    """weights and squared ratios by column, bias, and the logistic (slope, offset)."""

    def __init__(self, weights, squares, bias, slope, offset):
        self.weights, self.squares, self.bias, self.slope, self.offset = weights, squares, bias, slope, offset

    def margin(self, at: np.ndarray) -> float:
        if not len(at):
            return self.bias
        return float(self.weights[at].sum() / max(np.sqrt(self.squares[at].sum()), 1e-12)) + self.bias

    def score(self, at: np.ndarray) -> float:
        z = self.slope * self.margin(at) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def constant(probability: float) -> Nbsvm:
    zero = np.zeros(FEATURES, np.float32)
    return Nbsvm(zero, zero, 0.0, 0.0, float(np.log(probability / (1 - probability))))


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Nbsvm:
    """NBSVM by dual coordinate descent (Wang & Manning 2012; Hsieh et al. 2008, L1 loss)."""
    n, ones = len(rows), int(labels.sum())
    if n == 0:
        return constant(0.5)
    if ones in (0, n):
        return constant((ones + 1) / (n + 2))
    pos, neg = np.full(FEATURES, SMOOTHING), np.full(FEATURES, SMOOTHING)
    for at, y in zip(rows, labels, strict=True):
        (pos if y else neg)[at] += 1
    ratio = np.log(pos / (ones + 2 * SMOOTHING)) - np.log(neg / (n - ones + 2 * SMOOTHING))
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    # every fifth row of either class calibrates
    hold = np.zeros(n, bool)
    for y in (0, 1):
        own = order[labels[order] == y]
        hold[own[: len(own) // 5]] = True
    train = np.flatnonzero(~hold)
    sign = np.where(labels == 1, 1.0, -1.0)
    share = ones / n
    cost = np.where(labels == 1, COST * 0.5 / share, COST * 0.5 / (1 - share))
    scale = [1 / max(np.sqrt((ratio[at] ** 2).sum()), 1e-12) for at in rows]
    w, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(n)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(train):
            at = rows[i]
            x = ratio[at] * scale[i]
            g = sign[i] * (w[at] @ x + bias) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), cost[i])  # rows have length 1, and the bias term 1
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * x
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    model = Nbsvm((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, 1.0, 0.0)
    check = np.flatnonzero(hold) if hold.sum() >= 10 and 0 < labels[hold].sum() < hold.sum() else np.arange(n)
    z = np.array([model.margin(rows[i]) for i in check])
    y = labels[check].astype(float)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of Platt's logistic fit
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -40, 40)))
        v = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - target) * z).sum() + 1e-3 * slope, (p - target).sum()])
        hess = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        delta = np.linalg.solve(hess, grad)
        slope, offset = slope - delta[0], offset - delta[1]
        if abs(delta).max() < 1e-8:
            break
    return Nbsvm(model.weights, model.squares, bias, float(slope), float(offset))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Nbsvm:
    """Fit on at most TRAIN_ROWS labelled documents that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRAIN_ROWS)
        .select("doc_id", "quality")
    )
    texts = docs.join(F.broadcast(chosen), "doc_id")  # at most TRAIN_ROWS rows of two numbers
    rows = map_arrow(
        texts,
        lambda c: {
            "doc_id": c["doc_id"],
            "quality": c["quality"],
            "at": [features(t).astype(np.int32) for t in c["text"].to_pylist()],
        },
        "doc_id long, quality int, at array<int>",
    ).toPandas()
    rows = rows.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    return fit([np.asarray(a, np.int64) for a in rows["at"]], rows["quality"].to_numpy())


def scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    model = spark.sparkContext.broadcast(train(spark, docs, labels))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = map_arrow(
        docs,
        lambda c: {
            "doc_id": c["doc_id"],
            "score": [model.value.score(features(t)) for t in c["text"].to_pylist()],
        },
        "doc_id long, score double",
    )
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted 0; columns stay as they are."""
    model = spark.sparkContext.broadcast(train(spark, docs, labels))

    @F.pandas_udf("boolean")
    def good(texts):
        return texts.map(lambda t: model.value.score(features(t)) >= THRESHOLD)

    return docs.where(good(F.col("text").cast("string")))
