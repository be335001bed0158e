"""Captured product pages of shops that answer in JSON, as detail rows for ``items.merge_details``.

captures(id, source, payload) give one row (id, price, currency, description, gtin, origin, brand, rating, reviews, sold,
sections) each.  Everything is a projection inside the JVM; what a payload lacks is null, and sections without text are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, text_from_html, truncate
from .captures import by_source

FIELDS = {
    "price": "double", "currency": "string", "description": "string", "gtin": "string", "origin": "string", "brand": "string", "rating": "double",
    "reviews": "long", "sold": "long", "sections": "map<string,string>",
}
# Codes of attributes, and headers of text blocks, by the section that they give.
TIKI_SECTIONS = {
    "ingredients_mb": "ingredients", "ingredients": "ingredients", "origin": "origin", "expiry_time": "expiry", "product_weight_mb": "weight",
    "volume": "weight", "storage_instructions": "storage", "instructions_for_use": "usage", "age_group": "age", "suitable_age": "age", "warning": "warnings",
}
DM_SECTIONS = {
    "Zutaten": "ingredients", "Aufbewahrungshinweise": "storage", "Zubereitung": "usage", "Verwendungshinweise": "usage", "Allergene": "warnings",
    "Warnhinweise": "warnings", "Produktbeschreibung": "description",
}
#: Texts that stand where a shop knows nothing.
PLACEHOLDER = r"(?iu)tham khảo|xem mô tả|đang cập nhật"


def at(path: str) -> Column:
    return F.nullif(F.get_json_object("payload", f"$.{path}"), F.lit(""))


def section(value: Column, n: int = 500) -> Column:
    """Cleaned visible text of at most n signs; null for none."""
    return F.nullif(truncate(text_from_html(value), n), F.lit(""))


def _named(**sections: Column) -> Column:
    both = F.map_from_arrays(F.array(*map(F.lit, sections)), F.array(*sections.values()))
    return F.map_filter(both, lambda _, v: v.isNotNull())


def _lookup(pairs: Mapping[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), key)


def _entries(found: Column, last: bool) -> Column:
    """A map of struct(name, text) entries; of equal names the first or the last text stays."""
    good = F.filter(found, lambda e: e["name"].isNotNull() & (e["text"] != ""))
    ordered = F.reverse(good) if last else good
    names = F.array_distinct(F.transform(ordered, lambda e: e["name"]))
    # the first entry of each name, told by the place of the name
    texts = F.transform(names, lambda n: F.get(F.filter(ordered, lambda e: e["name"] == n), F.lit(0))["text"])
    return F.map_from_arrays(names, texts)


def _tiki() -> dict[str, Column]:
    groups = F.from_json(at("specifications"), "array<struct<attributes:array<struct<code:string,name:string,value:string>>>>")
    attributes = F.flatten(F.filter(F.transform(groups, lambda g: g["attributes"]), lambda a: a.isNotNull()))

    def entry(a: Column) -> Column:
        name, value = _lookup(TIKI_SECTIONS, a["code"]), clean(text_from_html(a["value"]))
        # a bare number is a weight in kilograms
        bare = F.replace(value, F.lit(","), F.lit(".")).try_cast("double") * 1000
        grams = F.concat(F.when(bare == F.floor(bare), F.floor(bare).cast("string")).otherwise(bare.cast("string")), F.lit("g"))
        text = F.when((name == "weight") & value.rlike(r"^[0-9]+([.,][0-9]+)?$"), grams).otherwise(truncate(value, 400))
        return F.struct(name.alias("name"), F.when(~value.rlike(PLACEHOLDER), text).otherwise("").alias("text"))

    origin = F.get(F.filter(attributes, lambda a: a["code"] == "origin"), F.lit(0))["value"]
    return {
        "price": at("price"), "currency": F.lit("VND"), "description": truncate(F.coalesce(at("short_description"), text_from_html(at("description"))), 600),
        "origin": origin, "brand": at("brand.name"), "rating": at("rating_average"), "reviews": at("review_count"),
        "sold": F.coalesce(at("all_time_quantity_sold"), at("quantity_sold.value")),
        "sections": _entries(F.transform(attributes, entry), last=True),
    }


def _target() -> dict[str, Column]:
    item = "data.product.item."
    bullets = F.transform(F.from_json(at(item + "product_description.bullet_descriptions"), "array<string>"), lambda b: clean(text_from_html(b)))

    def bullet(pattern: str) -> Column:
        return F.regexp_replace(F.get(F.filter(bullets, lambda b: b.rlike("(?i)" + pattern)), F.lit(0)), r"^[^:]+:\s*", "")

    facts = item + "enrichment.nutrition_facts."
    return {
        "description": section(at(item + "product_description.downstream_description"), 600), "gtin": at(item + "primary_barcode"),
        "sections": _named(
            ingredients=section(F.coalesce(at(facts + "ingredients"), at(facts + "value_prepared_list[0].ingredients"))), age=section(bullet("^Age Level")),
            warnings=section(F.coalesce(at(facts + "warning"), bullet("^Allergens?"))), usage=section(bullet("^State of Readiness|^Preparation")),
        ),
    }


def _woolworths() -> dict[str, Column]:
    a = "AdditionalAttributes."
    maybe = at(a + "allergenmaybepresent")
    allergens = F.concat_ws(". ", at(a + "allergystatement"), F.when(maybe.isNotNull(), F.concat(F.lit("May contain: "), maybe)))
    return {
        "description": section(F.coalesce(at("Product.RichDescription"), at(a + "description")), 600),
        "sections": _named(
            ingredients=section(at(a + "ingredients")), storage=section(at(a + "storageinstructions")),
            usage=section(F.coalesce(*(at(a + n) for n in ("directions", "usageinstructions", "preparationinstructions")))),
            warnings=section(allergens), age=section(F.coalesce(at(a + "lifestageage"), at(a + "suitablefor"))), origin=section(at("CountryOfOriginLabel"), 120),
        ),
    }


def _dm() -> dict[str, Column]:
    groups = F.from_json(at("descriptionGroups"), "array<struct<header:string,contentBlock:string>>")

    def entry(g: Column) -> Column:
        name = _lookup(DM_SECTIONS, g["header"])
        # the texts of a block, however nested: every JSON text that no colon follows as after a field's name
        texts = F.regexp_extract_all(g["contentBlock"], F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
        values = F.filter(texts, lambda t: t.endswith('"'))
        plain = F.transform(values, lambda t: F.coalesce(F.get_json_object(F.concat(F.lit('{"t":'), t, F.lit("}")), "$.t"), F.lit("")))
        text = F.array_join(plain, " ")
        return F.struct(name.alias("name"), F.coalesce(section(text, 600), F.lit("")).alias("text"))

    found = _entries(F.transform(groups, entry), last=False)
    return {
        "description": F.element_at(found, "description"),
        "sections": F.transform_values(F.map_filter(found, lambda k, _: k != "description"), lambda _, v: truncate(v, 500)),
    }


def _off() -> dict[str, Column]:
    prices = F.from_json(at("items"), "array<struct<price:double,currency:string,date:string>>")
    newest = F.get(F.array_sort(prices, lambda a, b: F.when(a["date"] > b["date"], -1).when(a["date"] < b["date"], 1).otherwise(0)), F.lit(0))
    return {"price": newest["price"], "currency": newest["currency"], "sections": F.create_map().cast("map<string,string>")}


READERS: dict[str, Callable[[], dict[str, Column]]] = {
    "tiki": _tiki, "target": _target, "woolworths": _woolworths, "dm": _dm, "off": _off,
}


def _read(captures: DataFrame, sources: Sequence[str]) -> DataFrame:
    readers = {s: READERS[s]() for s in sources}
    columns = []
    for name, kind in FIELDS.items():
        given = {s: fields[name].cast(kind) for s, fields in readers.items() if name in fields}
        columns.append((by_source(given) if given else F.lit(None).cast(kind)).alias(name))
    return captures.where(F.col("source").isin(*sources)).select("id", "source", *columns)


def read(captures: DataFrame, source: str) -> DataFrame:
    """Detail rows of one source's captures; a payload that is no JSON gives a row of nulls."""
    return _read(captures, [source])


def read_all(captures: DataFrame) -> DataFrame:
    """Detail rows of every source that has a reader, in one pass over the captures."""
    return _read(captures, list(READERS))
