"""Market insights: group statistics, histograms, facets, co-occurrence, cross-country gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.price import nice_step


#: Values of one sign within about 0.4 % of each other share a bucket; all finite doubles give fewer than 800,000.
_BUCKETS_PER_E, _BUCKET_ZERO = 256, 200_000


def _bucket(v: Column) -> Column:
    """A number that never falls where v grows, told by v alone."""
    size = F.floor(F.log(F.abs(v)) * _BUCKETS_PER_E).cast("long") + _BUCKET_ZERO
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """keys, n (values that are not null) and exact linear quantiles q0, q1, ... by key, as doubles; no keys: one row.

    Values are counted first, map-side, so a hot key moves its distinct values.  Ranks are told in two steps: a running
    count within a bucket of neighbouring values, which deals a hot key's values to many tasks in their order, and the
    counts of the buckets below.  The two values around (n - 1) p then are maxima.  No task holds a key's values.
    Null keys are a group; null values don't count, so a key without values is missing.
    """
    # one key, which is never null and equal where its parts are, null or not
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    counts = (
        df.select(group.alias("__k"), F.col(value).cast("double").alias("__v"))
        .where("__v is not null")
        .groupBy("__k", "__v")
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__b", _bucket(F.col("__v")))
    )
    within = Window.partitionBy("__k", "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("__k", "__b").agg(F.sum("__c").alias("__s"))
    bases = sums.select(
        "__k", "__b", F.coalesce(F.sum("__s").over(below), F.lit(0)).alias("__base"), F.sum("__s").over(Window.partitionBy("__k")).alias("__n")
    )
    start = F.col("__base") + F.coalesce("__before", F.lit(0))
    placed = counts.withColumn("__before", F.sum("__c").over(within)).join(bases, ["__k", "__b"]).withColumn("__start", start)

    def held(rank: Column) -> Column:
        return F.max(F.when((F.col("__start") <= rank) & (rank < F.col("__start") + F.col("__c")), F.col("__v")))

    each = []
    for i, p in enumerate(at):
        place = (F.col("__n") - 1) * p
        each += [held(F.floor(place)).alias(f"__lo{i}"), held(F.ceil(place)).alias(f"__hi{i}")]
    picked = placed.groupBy("__k").agg(F.max("__n").alias("n"), *each)
    lo, hi, place = (lambda i: F.col(f"__lo{i}")), (lambda i: F.col(f"__hi{i}")), (lambda p: (F.col("n") - 1) * p)
    return picked.select(*(F.col("__k")[k].alias(k) for k in keys), "n", *((lo(i) + (hi(i) - lo(i)) * (place(p) - F.floor(place(p)))).alias(f"q{i}") for i, p in enumerate(at)))


def group_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows, priced rows, median, least and most by key; rows without a key are left out."""
    rows = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    ends = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("n_priced"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    medians = order_statistics(rows, [key], value, (0.5,)).select(key, F.col("q0").alias("median"))
    return ends.join(medians, key, "left").select(key, "n", "n_priced", "median", "low", "high")


def headline(df: DataFrame, price: str, brand: str) -> DataFrame:
    """One row: products, priced, brands and the median price; null prices and brands don't count."""
    counts = df.agg(F.count(F.lit(1)).alias("products"), F.count(price).alias("priced"), F.count_distinct(brand).alias("brands"))
    median = order_statistics(df, [], price, (0.5,)).select(F.col("q0").alias("median_price"))
    # one row each
    return counts.join(F.broadcast(median), how="left")


def quantiles(df: DataFrame, value: str, at: Sequence[float], least: int = 3) -> DataFrame:
    """n and exact linear quantiles of all rows, null for fewer than least values."""
    n = df.agg(F.count(value).alias("n"))
    found = order_statistics(df, [], value, at).drop("n")
    # one row each
    row = n.join(F.broadcast(found), how="left")
    return row.select("n", *(F.when(F.col("n") >= least, F.round(F.col(f"q{i}"), 2)).alias(f"p{round(p * 100)}") for i, p in enumerate(at)))


def histogram(df: DataFrame, value: str, bins: int = 10, least_step: float = 1000.0) -> DataFrame:
    """(x0, x1, n): about ten bins of a round step up to the 95th percentile, and the rest in an open one."""
    v = F.col(value)
    cut = order_statistics(df, [], value, (0.95, 0.0)).select(F.col("q0").alias("p95"), F.col("q1").alias("low"))
    step = nice_step(F.greatest(F.lit(least_step), (F.col("p95") - F.col("low")) / bins))
    cut = cut.select("p95", "low", step.alias("step")).select(
        "p95", "step", (F.floor(F.col("low") / F.col("step")) * F.col("step")).alias("start")
    ).select("step", "start", F.floor((F.col("p95") - F.col("start")) / F.col("step")).cast("long").alias("last"))
    # one row of three numbers
    put = df.where(v.isNotNull()).join(F.broadcast(cut)).select(
        F.least(F.floor((v - F.col("start")) / F.col("step")).cast("long"), F.col("last") + 1).alias("bin")
    )
    counts = put.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    frame = cut.select("step", "start", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") + 1)).alias("bin"))
    out = frame.join(counts, "bin", "left").where((F.col("bin") <= F.col("last")) | (F.col("n") > 0))
    x0 = F.col("start") + F.col("bin") * F.col("step")
    return out.select(
        x0.alias("x0"), F.when(F.col("bin") <= F.col("last"), x0 + F.col("step")).alias("x1"), F.coalesce("n", F.lit(0)).alias("n")
    )


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(each.alias("f")).select("f.facet", "f.value").where("value is not null").groupBy("facet", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def label_frequency(df: DataFrame, labels: Column) -> DataFrame:
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def cheapest_abroad(df: DataFrame, home: str, brand: str = "brand", country: str = "country", price: str = "price") -> DataFrame:
    """Per brand: home median, the foreign country of lowest median, and how much dearer home is in percent."""
    medians = order_statistics(df, [brand, country], price, (0.5,)).select(brand, country, F.col("q0").alias("m"))
    away = F.when(F.col(country) != home, F.struct("m", country))
    both = medians.groupBy(brand).agg(
        F.max(F.when(F.col(country) == home, F.col("m"))).alias("home_median"), F.min(away).alias("low")
    )
    return both.where("home_median is not null and low is not null").select(
        brand,
        "home_median",
        F.col("low")[country].alias("cheapest_country"),
        F.col("low.m").alias("cheapest_median"),
        ((F.col("home_median") - F.col("low.m")) / F.col("low.m") * 100).alias("gap_percent"),
    )


def co_occurrence(df: DataFrame, words: Column, stop: Sequence[str], seed: Sequence[str], n: int = 30) -> DataFrame:
    """The n words that stand in most rows, each counted once a row, without stop and seed words."""
    each = df.select(F.explode(F.array_distinct(words)).alias("word")).where(
        (F.length("word") >= 2) & ~F.col("word").isin(*stop, *seed)
    )
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(n)
