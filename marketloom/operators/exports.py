"""What leaves the engine: the column sets of exports, and lines in the formats that spreadsheets read.

Each is a projection.  Names of sources, countries and markets come from small maps that are parameters;
a key without a name gives null.  Lists are joined by "; ".
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.price import half_up

SECTIONS = ("ingredients", "usage", "storage", "origin", "expiry")
#: Sections whose origin an export states.
NOTED = ("ingredients", "storage")


def named(key: Column, names: Mapping[str, str] | None) -> Column:
    """A key's name; without a map the key itself."""
    if not names:
        return key
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)


def shown_section(name: str, own: str = "sections", borrowed: str = "borrowed") -> Column:
    """An item's own section, else the one borrowed from a donor; empty counts as missing.

    ``borrowed`` maps a section to struct(text, donor, score)."""
    return F.coalesce(F.nullif(F.element_at(own, name), F.lit("")), F.element_at(borrowed, name)["text"])


def section_note(name: str, own: str = "sections", borrowed: str = "borrowed", notes: str = "section_notes") -> Column:
    """Where the shown section is from: the item's page, a noted source, or a donor; null if there is none."""
    has = F.nullif(F.element_at(own, name), F.lit("")).isNotNull()
    donor = F.element_at(borrowed, name)["donor"].cast("string")
    return F.when(has, F.coalesce(F.element_at(notes, name), F.lit("product page"))).when(donor.isNotNull(), F.concat(F.lit("item "), donor))


def result_rows(items: DataFrame, *, sources: Mapping[str, str] | None = None, countries: Mapping[str, str] | None = None,
                markets: Mapping[str, str] | None = None) -> DataFrame:
    """The 29 columns of a result export.

    items as ``make_items`` gives them, with countries, borrowed and section_notes where they are known; what a
    table lacks is null."""
    kinds = {
        "countries": "array<string>", "borrowed": "map<string,struct<text:string,donor:string,score:double>>", "section_notes": "map<string,string>"
    }
    items = items.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in items.columns})
    country = F.when(
        F.size("countries") > 1, F.array_join(F.transform("countries", lambda c: named(c, countries)), "; ")
    ).otherwise(named(F.col("country"), countries))
    notes = F.nullif(
        F.concat_ws("; ", *(F.when(shown_section(s).isNotNull(), F.concat(F.lit(f"{s}: "), section_note(s))) for s in NOTED)), F.lit("")
    )
    return items.select(
        "title", "brand", named(F.col("source"), sources).alias("source"), "seller", country.alias("country"),
        named(F.col("market"), markets).alias("market"), "price", "currency", "price_vnd", "original_price_vnd", "discount",
        F.col("qty.label").alias("pack"), "price_per_100_vnd", "age_months", "type", F.array_join("claims", "; ").alias("claims"),
        F.array_join("allergens", "; ").alias("allergens"), "rating", "reviews", "sold",
        *(shown_section(s).alias(s) for s in ("ingredients", "usage", "storage", "origin", "expiry")),
        notes.alias("section_source"), F.coalesce(F.nullif("description", F.lit("")), "snippet").alias("description"), "url", "image",
    )


def chosen_rows(items: DataFrame, chosen: DataFrame, key: str = "id", **names) -> DataFrame:
    """The result export of chosen(key) rows only, as for a comparison."""
    return result_rows(items.join(chosen.select(key).distinct(), key, "left_semi"), **names)


def margin_percent(target: Column, cost: Column) -> Column:
    """Gross margin of a planned price over its cost; null while either is missing or 0."""
    return (F.nullif(target, F.lit(0.0)) - F.nullif(cost, F.lit(0.0))) / F.nullif(target, F.lit(0.0)) * 100


def watch_rows(watch: DataFrame, *, sources: Mapping[str, str] | None = None, countries: Mapping[str, str] | None = None,
               states: Mapping[str, str] | None = None) -> DataFrame:
    """The 15 columns of a watch list's export; watch(item struct, status, supplier, cost, target_price, note, saved_at)."""
    margin = half_up(margin_percent(F.col("target_price"), F.col("cost")) * 10) / 10
    return watch.select(
        "item.title", "item.brand", named(F.col("item.source"), sources).alias("source"), named(F.col("item.country"), countries).alias("country"),
        "item.price_vnd", "item.price", "item.currency", named(F.col("status"), states).alias("status"), "supplier", "cost", "target_price",
        margin.alias("margin_percent"), "note", "item.url", "saved_at",
    )


def opportunity_rows(checked: DataFrame, *, countries: Mapping[str, str] | None = None, classes: Mapping[str, str] | None = None,
                     links: int = 5) -> DataFrame:
    """The 20 columns of an import export, best score first.

    checked: product struct, score, demand, parts array<struct<label,points>>, class, uncertain, reasons, listings, chains,
    importers, brand_importer, sold, hand_carried, min_price_vnd, match_urls (best first)."""
    parts = F.transform("parts", lambda p: F.concat_ws(" +", p["label"], p["points"].cast("string")))
    return checked.orderBy(F.desc("score"), "product.id").select(
        "score", "demand", F.array_join(parts, "; ").alias("parts"), "product.title", "product.brand",
        named(F.col("product.country"), countries).alias("country"), "product.price_vnd", "product.reviews",
        named(F.col("class"), classes).alias("class"), F.when(F.col("uncertain"), "yes").otherwise("").alias("uncertain"),
        F.array_join("reasons", " | ").alias("reasons"), "listings", F.array_join("chains", "; ").alias("chains"),
        F.array_join("importers", "; ").alias("importers"), "brand_importer", "sold", "hand_carried", "min_price_vnd",
        "product.url", F.array_join(F.slice("match_urls", 1, links), " ").alias("match_urls"),
    )


#: What a candidate brings into the import check.
SLIM = (
    "id", "title", "brand", "image", "url", "country", "market", "gtin", "price_vnd", "price", "currency", "rating", "reviews", "sold",
    "source", "qty", "rank",
)


def slim(items: DataFrame) -> DataFrame:
    """The 17 columns of an import candidate; a table without ranks gives null ranks."""
    have = set(items.columns)
    return items.select(*(F.col(c) if c in have else F.lit(None).alias(c) for c in SLIM))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row; fields without a value stay, as null."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("value"))
