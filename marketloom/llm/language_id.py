"""Operator 8: language by compression.

Every language has a zstandard raw-content dictionary, the joined texts of a bounded sample of its
documents.  A text is compressed once with each; the dictionary that makes it smallest names its
language.  A prediction whose lead over the second is a narrow share of its size is rejected.

A text of a few words often saves no byte with any dictionary.  Where a short text's lead is narrow, it
is measured again behind contexts: the dictionary is cut into ``SLICES``, the first bytes of each slice
are context, the rest its dictionary, and the bytes that the text adds to each context are summed.

Learned from text and non-null lang of documents whose crc32(doc_id) mod 4 is not 2: per language
the ``SAMPLE_DOCUMENTS`` with the smallest hash of doc_id, up to ``DICTIONARY_BYTES``.

Nulls: a null text, or one without a letter, is ``und`` with score 0 and is rejected.  Ties go to
the language that sorts first.  Without any learned language every row is ``und``.  A null doc_id is
not learned from and counts as held_out false.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow

SAMPLE_DOCUMENTS = 200
DICTIONARY_BYTES = 160_000
LEVEL = 6
#: A lead below this share of the smallest size is too narrow.
MARGIN = 0.002
#: Texts of at most this many bytes are measured behind contexts where their lead is narrow.
SHORT_BYTES = 100
SLICES = 16
CONTEXT_BYTES = 1_000
#: Steepness of the score over relative sizes.
STEEPNESS = 60.0
UNKNOWN = "und"


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(spark: SparkSession, docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content by language, from the bounded sample."""
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )
    usable = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        usable.select("lang", "doc_id")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= SAMPLE_DOCUMENTS)
        .select("lang", "doc_id", "place")
    )
    # at most SAMPLE_DOCUMENTS rows of a language
    # what lies beyond a dictionary's size could not be used, so long texts give their first part to it
    rows = usable.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "place", F.substring("text", 1, DICTIONARY_BYTES).alias("text")).collect()
    out: dict[str, bytes] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["place"], r["text"])):
        have = out.get(row["lang"], b"")
        text = folded(row["text"])[: DICTIONARY_BYTES - 1] + b"\n"
        if len(have) + len(text) <= DICTIONARY_BYTES:
            out[row["lang"]] = have + text
        else:
            out.setdefault(row["lang"], have)
    return {k: v for k, v in out.items() if v}


def folded(text: str) -> bytes:
    """Lower case: capitals would hide words that a dictionary holds."""
    return text.lower().encode("utf-8", "surrogatepass")


def _coder(content: bytes) -> zstandard.ZstdCompressor:
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(content) < 8:  # no dictionary for zstandard
        return zstandard.ZstdCompressor(**plain)
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, **plain)


def _contexts(content: bytes) -> list[tuple[zstandard.ZstdCompressor, bytes, int]]:
    """Per slice of a dictionary: its coder, its context and the context's size."""
    out = []
    for i in range(SLICES):
        part = content[i * len(content) // SLICES : (i + 1) * len(content) // SLICES]
        coder, context = _coder(part[CONTEXT_BYTES:]), part[:CONTEXT_BYTES] + b" "
        out.append((coder, context, len(coder.compress(context))))
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(dictionaries)
        self.coders = [_coder(dictionaries[language]) for language in self.languages]
        self._dictionaries = dictionaries
        self._contexts: list[list[tuple]] = []

    def added(self, raw: bytes) -> np.ndarray:
        """Bytes that a short text adds to the contexts of each language, summed."""
        if not self._contexts:
            self._contexts = [_contexts(self._dictionaries[language]) for language in self.languages]
        return np.array(
            [sum(len(c.compress(context + raw)) - alone for c, context, alone in row) for row in self._contexts], float
        )

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and relative lead."""
        if not text or not self.coders or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        raw = folded(text)
        sizes = np.array([len(c.compress(raw)) for c in self.coders], float)
        found = self._judged(sizes)
        if found[2] < MARGIN and len(raw) <= SHORT_BYTES:
            found = self._judged(self.added(raw))
        return found

    def _judged(self, sizes: np.ndarray) -> tuple[str, float, float]:
        best = int(sizes.argmin())
        over = (sizes - sizes[best]) / max(sizes[best], 1.0)
        score = 1 / float(np.exp(-STEEPNESS * over).sum())
        lead = float(np.partition(over, 1)[1]) if len(sizes) > 1 else 1.0
        return self.languages[best], score, lead


_ready: dict[int, Classifier] = {}


def _classifier(shared) -> Classifier:
    """One classifier per Python worker and model; compressors cannot be pickled."""
    key = shared.value[0]
    if key not in _ready:
        _ready.clear()
        _ready[key] = Classifier(shared.value[1])
    return _ready[key]


def _share(spark: SparkSession, docs: DataFrame):
    dictionaries = learn(spark, docs)
    key = hash(tuple(sorted(dictionaries.items())))
    return spark.sparkContext.broadcast((key, dictionaries))


def predictions(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, rejected."""
    shared = _share(spark, docs)

    def rows(columns: dict) -> dict:
        found = [_classifier(shared).predict(t) for t in columns["text"].to_pylist()]
        return {
            "doc_id": columns["doc_id"],
            "lang_pred": [f[0] for f in found],
            "score": [f[1] for f in found],
            "rejected": [f[2] < MARGIN for f in found],
        }

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = map_arrow(plain, rows, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_certain(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without rejected rows; columns stay as they are."""
    shared = _share(spark, docs)

    @F.pandas_udf("boolean")
    def certain(texts):
        return texts.map(lambda t: _classifier(shared).predict(t)[2] >= MARGIN)

    return docs.where(certain(F.col("text").cast("string")))
