"""Operator 13: documents drawn by importance weights towards a target's n-gram distribution.

Features are runs of 1 to ``most_words`` consecutive words.  A feature's bucket is its checksum modulo ``buckets``; a
bucket's gain is the smoothed logarithm of its share in the target over its share in the documents, and a document's
weight the mean gain of its features.  Gumbel noise, told by the document's id and a seed, makes the highest scores a
draw without replacement in proportion to the weights (in thousandths of the logarithm).

Plan.  Documents become feature counts once, where they are read, in a written table.  Counts of equal strings are
added up over both tables into a dictionary of distinct strings, and only that is hashed.  Buckets are sums over
the dictionary: their number is a parameter, so gains are broadcast to it.  Gains come back to the documents' counts
by a join on the string: the ``HEAD`` most frequent strings, of at most ``HEAD_BYTES`` bytes each, are broadcast and
serve most counts without a shuffle; all others meet the rest of the dictionary in a shuffled join, in which no short
string is hot and Spark splits long hot ones.  Ranks come from a range sort of (score, doc_id): a row's
number within its partition and the sum of those before it.

Nulls: a null text has no features and weight 0; a null doc_id has no score and is neither drawn nor counted among
those drawn from.  Rows without features have weight 0.  Repeated rows are rows of their own, which stand next to each
other in the order of a tie.  Further columns, whatever their names, are neither read nor returned.  Empty tables:
without documents no rows; without a target all gains come from smoothing.  Very long texts are counted whole.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, partitions

BUCKETS = 10_000
MOST_WORDS = 1
SEED = 2024
#: Of all documents with at least LEAST_WORDS words, DRAWN percent are drawn.
LEAST_WORDS = 20
DRAWN = 10
#: Strings whose gains are broadcast, and bytes of each at most: 4 MB together.
HEAD = 32_768
HEAD_BYTES = 64

#: Words of bytes, after A-Z are lower-cased: all but ASCII signs that are neither digits nor lower-case letters.
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: bytes, most_words: int = MOST_WORDS) -> tuple[Counter, int]:
    """Counts of a text's features, and its number of words."""
    words = _WORDS.findall(text.lower())  # bytes lower-case ASCII alone
    counts = Counter(words)
    for n in range(2, most_words + 1):
        counts.update(map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)))
    return counts, len(words)


def _counter(most_words: int):
    def rows(columns: dict) -> dict:
        import pyarrow as pa

        out: dict = {"doc_id": columns["doc_id"], "n_words": [], "n_features": []}
        strings: list[bytes] = []
        counts: list[int] = []
        offsets = [0]
        for text in columns["text"].cast(pa.binary()).to_pylist():
            found, words = features(text or b"", most_words)
            strings += found.keys()
            counts += found.values()
            offsets.append(len(strings))
            out["n_words"].append(words)
            out["n_features"].append(found.total())
        at = pa.array(offsets, pa.int32())
        # cuts lie between whole characters, so the bytes are UTF-8
        out["features"] = pa.ListArray.from_arrays(at, pa.array(strings, pa.binary()).cast(pa.string()))
        out["counts"] = pa.ListArray.from_arrays(at, pa.array(counts, pa.int32()))
        return out

    return rows


def counted(docs: DataFrame, most_words: int) -> DataFrame:
    """doc_id, number of words, number of features, distinct features and their counts of each of docs(doc_id, text)."""
    return map_arrow(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        _counter(most_words),
        "doc_id long, n_words long, n_features long, features array<string>, counts array<int>",
    )


def _pairs(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.inline(F.arrays_zip(F.col("features").alias("feature"), F.col("counts").alias("n"))).alias("feature", "n"))


def dictionary(scratch: Scratch, documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """feature, how often it occurs in the documents, and its bucket's gain, of the documents' distinct features."""
    both = _pairs(documents).select("feature", F.col("n").cast("long").alias("s"), F.lit(0).cast("long").alias("t")).union(
        _pairs(target).select("feature", F.lit(0).cast("long"), F.col("n").cast("long"))
    )
    strings = scratch.write(
        "strings",
        both.groupBy("feature")
        .agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
        .withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets),
    )
    sums = scratch.write("buckets", strings.groupBy("bucket").agg(F.sum("s").alias("bucket_s"), F.sum("t").alias("bucket_t")))
    all_s, all_t = sums.agg(F.coalesce(F.sum("bucket_s"), F.lit(0)), F.coalesce(F.sum("bucket_t"), F.lit(0))).first()
    s, t = F.col("bucket_s").cast("double"), F.col("bucket_t").cast("double")
    ratio = ((t + 1) * F.lit(float(all_s + buckets))) / ((s + 1) * F.lit(float(all_t + buckets)))
    gains = sums.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))
    return strings.where("s > 0").join(F.broadcast(gains), "bucket").select("feature", "s", "gain")


def weigh(
    spark: SparkSession, docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most_words: int = MOST_WORDS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """doc_id, n_words, n_features, weight (mean gain, floored; 0 without features) of each of docs(doc_id, text).

    ``target`` has the texts (doc_id or not, text) whose distribution the weights lean to.
    """
    scratch = scratch or Scratch(spark, "target_resampling")
    documents = scratch.write("counts", counted(docs, most_words).withColumn("uid", F.monotonically_increasing_id()))
    aims = counted(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), most_words)
    gains = scratch.write("gains", dictionary(scratch, documents, aims, buckets))
    scratch.drop("strings", "buckets")
    head = scratch.write(
        "head", gains.where(F.octet_length("feature") <= HEAD_BYTES).orderBy(F.desc("s"), "feature").limit(HEAD).select("feature", "gain")
    )
    keys = ("uid", "doc_id", "n_words", "n_features")
    zipped = F.arrays_zip(F.col("features").alias("feature"), F.col("counts").alias("n"))
    frequent = (
        documents.select(*keys, F.inline_outer(zipped).alias("feature", "n"))
        .join(F.broadcast(head), "feature", "left")
        .groupBy(*keys)
        .agg(F.sum(F.coalesce(F.col("n") * F.col("gain"), F.lit(0))).alias("g"))
    )
    rare = (
        _pairs(documents, "uid")
        .join(F.broadcast(head.select("feature")), "feature", "left_anti")
        .join(gains.select("feature", "gain"), "feature")
        .groupBy("uid")
        .agg(F.sum(F.col("n") * F.col("gain")).alias("rare_g"))
    )
    return frequent.join(rare, "uid", "left").select(
        "doc_id",
        "n_words",
        "n_features",
        # floored division of whole numbers
        F.when(F.col("n_features") > 0, F.expr("(g + coalesce(rare_g, 0) - pmod(g + coalesce(rare_g, 0), n_features)) div n_features"))
        .otherwise(F.lit(0))
        .cast("long")
        .alias("weight"),
    )


def scored(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score: the weight and Gumbel noise in thousandths, told by seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(u))))


def draw(
    spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = DRAWN, least_words: int = LEAST_WORDS,
    seed: int = SEED, buckets: int = BUCKETS, most_words: int = MOST_WORDS,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each of docs(doc_id, text); rank is null where a row is not drawn."""
    scratch = Scratch(spark, "target_resampling")
    rows = scratch.write("scores", scored(weigh(spark, docs, target, buckets, most_words, scratch), seed))
    scratch.drop("counts", "gains", "head")
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    order = (F.desc("score"), "doc_id", "n_features")
    # an id grows by one along a sorted partition; above its 33 lower bits stands the partition's number
    at = F.monotonically_increasing_id()
    ordered = scratch.write(
        "ordered",
        rows.where(may)
        .repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at")),
    )
    totals = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row for each range partition, so the windows over all of them are small
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select(
        "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.floor(F.sum("n").over(everything) * percent / 100).alias("drawn"),
    )
    rank = F.col("base") + F.col("at") + 1
    columns = ("doc_id", "n_features", "weight", "score")
    ranked = ordered.join(F.broadcast(bases), "part").select(*columns, F.when(rank <= F.col("drawn"), rank).alias("rank"))
    return ranked.union(rows.where(~may | may.isNull()).select(*columns, F.lit(None).cast("long")))


#: Words, dictionary, buckets, gains and draw in SQL; the checksum is folded over the bytes of distinct words.
ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS b))
), d AS (
  SELECT row_number() OVER () AS uid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), c AS (
  SELECT uid, f, count(*) AS n FROM (SELECT uid, unnest(w) AS f FROM d) GROUP BY uid, f
), s AS (SELECT f, sum(n) AS s FROM c GROUP BY f
), t AS (
  SELECT f, count(*) AS t FROM (SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark) GROUP BY f
), strings AS (
  SELECT coalesce(s.f, t.f) AS f, coalesce(s, 0) AS s, coalesce(t, 0) AS t, hex(encode(coalesce(s.f, t.f))) AS h
  FROM s FULL JOIN t ON s.f = t.f
), hashed AS (
  SELECT f, s, strings.t, xor(4294967295, list_reduce(list_prepend(4294967295,
    list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, y: xor(crc.t[(xor(c, y) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM strings CROSS JOIN crc
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(sum(t) AS DOUBLE) + 1) * CAST(sum(sum(s)) OVER () + 10000 AS DOUBLE)
    / ((CAST(sum(s) AS DOUBLE) + 1) * CAST(sum(sum(t)) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM hashed GROUP BY bucket
), m AS (
  SELECT c.uid, sum(c.n)::BIGINT AS n, sum(c.n * g.gain)::BIGINT AS total
  FROM c JOIN hashed USING (f) JOIN g USING (bucket) GROUP BY c.uid
), w AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(m.n, 0) AS n_features,
    CASE WHEN m.n > 0 THEN CAST(floor(m.total / m.n) AS BIGINT) ELSE 0 END AS weight,
    CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN m USING (uid)
), x AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score, n_words >= 20 AND doc_id IS NOT NULL AS may FROM w
), r AS (
  SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY may) AS n FROM x
)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND k <= n * 10 // 100 THEN k END AS rank FROM r
"""
