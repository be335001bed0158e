"""What the panels of a search show: task plans, engines of a page, opportunities, importers, changes, short lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, squash
from .history import daily_last_sum, weekly_rate

#: A compare set, the best-seller panel, open opportunities and an importer's pages to read hold so many rows.
COMPARED, TOP_SOLD, OPEN, IMPORTER_PAGES = 6, 10, 6, 5
# Where importers are looked for first.
IMPORTER_SOURCES = ("concung", "kidsplaza", "tiki", "lazada")


def task_plan(sources: DataFrame, markets: DataFrame) -> DataFrame:
    """(source, market): each enabled source in each market that it supports, global sources once under ``world``.

    sources(source, enabled, global, markets array) is a registry of bounded size; a market list of ``*`` supports all.
    """
    on = sources.where("enabled")
    asked = on.where("not global").select("source", F.explode("markets").alias("m"))
    # every market answers to its own name and to the sign for all
    names = markets.select("market", F.explode(F.array(F.col("market"), F.lit("*"))).alias("m")).distinct()
    return asked.join(names, "m").select("source", "market").distinct().union(on.where("global").select("source", F.lit("world").alias("market")))


def first_seen(rows: DataFrame, address: str, order: str, engine: str) -> DataFrame:
    """(address, first, engines): the first row of each address, and the engines that gave it, sorted."""
    return rows.groupBy(address).agg(F.min(order).alias("first"), F.array_sort(F.collect_set(engine)).alias("engines"))


def changed_since(rows: DataFrame, key: str, value: str, order: Sequence[str], t: str, since: int) -> DataFrame:
    """(key, before, after): the last value before a time and the last of all, where they differ."""
    place = F.struct(*order)
    both = rows.groupBy(key).agg(F.max_by(value, F.when(F.col(t) < since, place)).alias("before"), F.max_by(value, place).alias("after"))
    return both.where("before is not null and before <> after")


def site_groups(sites: DataFrame, group: str, site: str, size: int) -> DataFrame:
    """(group, part, sites): a group's sites in order, ``size`` a part, in one text with OR; lists of sites are short."""
    pos = F.row_number().over(Window.partitionBy(group).orderBy(site)) - 1
    parts = sites.select(site, group, F.floor(pos / size).alias("part"))
    names = F.transform(F.array_sort(F.collect_list(site)), lambda x: x.cast("string"))
    return parts.groupBy(group, "part").agg(F.array_join(names, " OR ").alias("sites"))


def cheapest(rows: DataFrame, group: Sequence[str], price: str) -> Column:
    """Whether a row's price is the lowest of its group."""
    return F.col(price) == F.min(price).over(Window.partitionBy(*group))


def brand_opportunities(scored: DataFrame, n: int = 12) -> DataFrame:
    """(brand, score, reviews, items, classes): a brand's best score and sums, the n best; brands that are only imported officially are none.

    scored(brand, score, reviews, cls).
    """
    rolled = scored.groupBy("brand").agg(
        F.max("score").alias("score"), F.sum("reviews").alias("reviews"), F.count(F.lit(1)).alias("items"),
        F.array_join(F.array_sort(F.collect_set("cls")), ",").alias("classes"),
    )
    return rolled.where("classes <> 'nkcn'").orderBy(F.desc("score"), F.desc("reviews"), "brand").limit(n)


def open_opportunities(scored: DataFrame, n: int = OPEN) -> DataFrame:
    """The n best products that are not imported officially, by score and then reviews."""
    value = F.col("score") * 1_000_000 + F.coalesce("reviews", F.lit(0))
    return scored.where("cls <> 'nkcn'").orderBy(value.desc(), "id").limit(n)


def importer_directory(listings: DataFrame, importer: str, key: Column, t: str | None = None) -> DataFrame:
    """(brand, importer_key, importer, seen[, first_seen, last_seen]): how often, and when, a brand's listings name a company.

    ``key`` makes a company's spellings equal; the smallest spelling is shown.
    """
    times = [F.min(t).alias("first_seen"), F.max(t).alias("last_seen")] if t else []
    return listings.groupBy("brand", key.alias("importer_key")).agg(F.min(importer).alias("importer"), F.count(F.lit(1)).alias("seen"), *times)


def importer_candidates(listings: DataFrame, n: int = IMPORTER_PAGES) -> DataFrame:
    """Of each brand the n listings whose pages are read for an importer, by source; sources that are not in the order come first."""
    place = F.array_position(F.array(*map(F.lit, IMPORTER_SOURCES)), F.col("source"))
    order = Window.partitionBy("brand").orderBy(F.coalesce(place, F.lit(0)), "listing")
    return listings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def importers_of(brands: DataFrame, of_run: DataFrame, directory: DataFrame, listings: DataFrame) -> DataFrame:
    """brands(brand) with ``importer`` and ``known_by``: this run's, else the directory's most seen, else of the brand's candidate listings.

    of_run(brand, importer), directory(brand, importer, seen), listings(brand, listing, source, importer); brands meet by
    their folded letters and digits, and stay without an importer where none is known.
    """
    key = squash(F.col("brand"))
    told = "importer is not null and importer <> ''"
    run = of_run.where(told).groupBy(key.alias("__k")).agg(F.min("importer").alias("__run"))
    most = directory.where(told).groupBy(key.alias("__k")).agg(F.max_by("importer", F.struct("seen", "importer")).alias("__book"))
    pages = importer_candidates(listings).where(told).groupBy(key.alias("__k")).agg(F.min_by("importer", F.struct("place", "listing")).alias("__page"))
    df = brands.withColumn("__k", key)
    for found in (run, most, pages):
        df = df.join(found, "__k", "left")
    by = F.when(F.col("__run").isNotNull(), "run").when(F.col("__book").isNotNull(), "directory").when(F.col("__page").isNotNull(), "listing")
    return df.withColumns({"importer": F.coalesce("__run", "__book", "__page"), "known_by": by}).drop("__k", "__run", "__book", "__page")


def product_history(snapshots: DataFrame) -> DataFrame:
    """One row: what a product's listings have sold by day, their weekly rates added up, when the first was seen, and how many snapshots there are.

    snapshots(key, t, sold).
    """
    days = daily_last_sum(snapshots, "key", "t", "sold")
    sums = days.agg(F.array_sort(F.collect_list(F.struct("day", "total"))).alias("days"))
    rates = weekly_rate(snapshots, "key", "t", "sold").agg(F.sum("rate").alias("sold_per_week"))
    seen = snapshots.agg(F.min("t").alias("first_seen"), F.count(F.lit(1)).alias("snapshots"))
    # one row each
    return seen.join(F.broadcast(rates), how="left").join(F.broadcast(sums), how="left")


def top_sold(items: DataFrame, n: int = TOP_SOLD) -> DataFrame:
    """The n items that sold most; items without a count are none."""
    return items.where("sold is not null").orderBy(F.desc("sold"), "id").limit(n)


def checking_order(products: DataFrame) -> DataFrame:
    """Products brand by brand, so that one search of a brand serves its neighbours."""
    return products.orderBy(fold(F.coalesce("brand", F.lit(""))), "id")


def compared(items: DataFrame, n: int = COMPARED) -> DataFrame:
    """The first n items that were put into the compare set."""
    return items.orderBy("added_at", "id").limit(n)


def tracked_first(rows: DataFrame) -> DataFrame:
    """Tracked products, the newest first."""
    return rows.orderBy(F.desc("added_at"), "id")


def of_class(checks: DataFrame, chip: str | None) -> DataFrame:
    """Checks of one import class; no chip shows all."""
    return checks if not chip else checks.where(F.col("class") == chip)


def union_of(*lists: Column) -> Column:
    """Members of several lists in order, once each."""
    return F.array_distinct(F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))))
