"""Watch lists and tracked listings: what has changed, since when, and how complete the rows are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.price import half_up
from .exports import margin_percent, shown_section
from .history import DAY_MS


def recent(history: DataFrame, t: str, now: Column, days: int = 90) -> DataFrame:
    """Points of the last days before now, both in milliseconds; the filter reaches the scan."""
    return history.where(F.col(t) >= now - days * DAY_MS)


def tracking(history: DataFrame, key: str, t: str) -> DataFrame:
    """(key, first_seen, last_seen, tracked_days): whole days between a key's first and last point, rounded."""
    ends = history.groupBy(key).agg(F.min(t).alias("first_seen"), F.max(t).alias("last_seen"))
    return ends.withColumn("tracked_days", half_up((F.col("last_seen") - F.col("first_seen")) / DAY_MS))


def first_priced(points: DataFrame, key: str, t: str, price: str) -> DataFrame:
    """(key, first_price): the price of a key's first point that has one."""
    return points.where(F.col(price).isNotNull()).groupBy(key).agg(F.min_by(price, t).alias("first_price"))


def watch_figures(watch: DataFrame) -> DataFrame:
    """watch(price, first_price, target_price, cost) with change_percent since the first price (0 without one), gross
    margin_percent, and vs_market_percent of the planned price; the latter two are null while an input is missing or 0."""
    price, first, target = (F.nullif(c, F.lit(0.0)) for c in ("price", "first_price", "target_price"))
    return watch.withColumns({
        "change_percent": F.coalesce((price - first) / first * 100, F.lit(0.0)),
        "margin_percent": margin_percent(F.col("target_price"), F.col("cost")),
        "vs_market_percent": (target - price) / price * 100,
    })


def watched(watch: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """watch and those of new (one row a key) that it lacks; a key that is there keeps its row as it is."""
    return watch.unionByName(new.join(watch.select(key), key, "left_anti"), allowMissingColumns=True)


def scaled(points: DataFrame, key: str, value: str) -> DataFrame:
    """points with ``y``: the value's place between its key's least (0) and most (1); 0 where all are equal.

    Least and most combine map-side and are joined back, so a hot key is no single task."""
    ends = points.groupBy(key).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    y = F.coalesce((F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)), F.lit(0.0))
    return points.join(ends, key).withColumn("y", F.when(F.col(value).isNotNull(), y)).drop("_low", "_high")


def leaders(df: DataFrame, group: str, member: str, n: int = 2) -> DataFrame:
    """(group, member, n, place): the members with most rows of each group; equal counts go by name."""
    counts = df.where(F.col(member).isNotNull()).groupBy(group, member).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), member))
    return counts.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def section_coverage(items: DataFrame, sections: Sequence[str]) -> DataFrame:
    """(section, items, percent): how many items show a section of their own or a borrowed one, whole percents."""
    counts = items.agg(
        F.count(F.lit(1)).alias("_all"), *(F.count(F.when(shown_section(s) != "", 1)).alias(s) for s in sections)
    )
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("section"), F.col(s).alias("items")) for s in sections)))
    percent = F.coalesce(half_up(F.col("items") / F.nullif("_all", F.lit(0)) * 100), F.lit(0))
    return counts.select("_all", each.alias("s")).select("s.section", "s.items", "_all").withColumn("percent", percent).drop("_all")


def class_counts(checked: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row: rows of each class, and all."""
    return checked.agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.col("class") == c).alias(c) for c in classes))


def refresh_counts(refreshed: DataFrame) -> DataFrame:
    """(ok, total) of refreshed(error) rows."""
    return refreshed.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count(F.lit(1)).alias("total"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    parts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
