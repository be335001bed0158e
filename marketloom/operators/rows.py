"""Row selection: filters, orders, first-wins dedupe, set operations, per-group limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold


def result_filter(df: DataFrame, *, relevant: bool = False, food: bool = False, source: str | None = None,
                  country: str | None = None, kind: str | None = None, age: tuple[int, int] | None = None,
                  priced: bool = False, least: float | None = None, most: float | None = None,
                  shops: bool = False, unsponsored: bool = False, claims: Sequence[str] = (),
                  without: Sequence[str] = (), words: str = "", text: Sequence[str] = ("title",)) -> DataFrame:
    """Rows that pass every given predicate; a predicate that is not given costs nothing.

    A missing relevance passes; a missing age or price fails where its predicate is given; a least or
    most of 0 is not given.
    """
    tests: list[Column] = []
    if relevant:
        tests.append(F.col("relevance").isNull() | (F.col("relevance") >= 0.45))
    if food:
        tests.append(~F.coalesce("nonFood", F.lit(False)))
    if source:
        tests.append(F.col("source") == source)
    if country:
        tests.append((F.col("country") == country) | F.array_contains(F.coalesce("countries", F.array()), country))
    if kind:
        tests.append(F.col("type") == kind)
    if age:
        tests.append(F.col("ageMonths").between(*age))
    if priced or least or most:
        tests.append(F.col("priceVND").isNotNull())
    if least:
        tests.append(F.col("priceVND") >= least)
    if most:
        tests.append(F.col("priceVND") <= most)
    if shops:
        tests.append(F.col("kind") != "web")
    if unsponsored:
        tests.append(~F.coalesce("sponsored", F.lit(False)))
    if claims:
        tests.append(F.size(F.array_except(F.array(*map(F.lit, claims)), "claims")) == 0)
    if without:
        tests.append(~F.coalesce(F.arrays_overlap("allergens", F.array(*map(F.lit, without))), F.lit(False)))
    hay = fold(F.concat_ws(" ", *text))
    # search words are folded by the same expression that folds the rows
    tests += [F.contains(hay, fold(F.lit(w))) for w in words.split()]
    for t in tests:
        df = df.where(t)
    return df


def relevance_score() -> Column:
    """What the result list is ordered by: relevance, and what a row has to show; later places of a source count less."""
    c = F.col
    return (
        F.coalesce(c("relevance"), F.lit(0.0))
        + 0.12 * c("priceVND").isNotNull().cast("int")
        + 0.06 * c("image").isNotNull().cast("int")
        + 0.05 * (c("kind") != "web").cast("int")
        + 0.04 * (F.size(F.coalesce("sections", F.create_map())) > 0).cast("int")
        - 0.003 * F.coalesce(c("pos"), F.lit(0))
    )


def ordered(df: DataFrame, order: str, tie: str = "ord") -> DataFrame:
    """The result list's orders; the order of arrival breaks ties."""
    c = F.col
    keys = {
        "relevance": lambda: [relevance_score().desc()],
        "price-asc": lambda: [c("priceVND").asc_nulls_last()],
        "price-desc": lambda: [c("priceVND").desc_nulls_last()],
        "p100-asc": lambda: [c("pricePer100VND").asc_nulls_last()],
        "sold-desc": lambda: [c("sold").desc_nulls_last()],
        "rating-desc": lambda: [c("rating").desc_nulls_last(), c("reviews").desc_nulls_last()],
        "discount-desc": lambda: [c("discount").desc_nulls_last()],
    }[order]()
    return df.orderBy(*keys, c(tie))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by a total order; an aggregate, so a hot key combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, *(F.col("__row")[c].alias(c) for c in rest))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark keeps n a task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(rank, place).where(F.col(rank) <= n)


def widen(some: DataFrame, more: DataFrame, key: str, least: int) -> DataFrame:
    """some, and where it holds fewer than least rows, those of more whose key it lacks."""
    few = some.limit(least).agg((F.count(F.lit(1)) < least).alias("few"))
    extra = more.join(some.select(key), key, "left_anti").join(F.broadcast(few), F.col("few")).drop("few")
    return some.unionByName(extra)


def first_provider(df: DataFrame, group: str, priority: str) -> DataFrame:
    """Per group the rows of its best non-empty provider."""
    best = df.groupBy(group).agg(F.min(priority).alias("__best"))
    return df.join(best, group).where(F.col(priority) == F.col("__best")).drop("__best")


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Upsert by key: the last row of each key wins."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, *(F.col("__row")[c].alias(c) for c in rest))


def patched(table: DataFrame, patch: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """table with the allowed columns of patch where it names them; all else stays."""
    p = patch.select(key, *(F.col(c).alias(f"__{c}") for c in allowed if c in patch.columns))
    out = table.join(p, key, "left")
    return out.select(
        *(F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in p.columns else F.col(c) for c in table.columns)
    )
