"""Connector rows become items: typed fields, prices in đồng, and everything that is derived from them.

All of it is one projection over a row's own columns, so building items is a map: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import brands as B
from ..functions import price as P
from ..functions import text as T
from ..functions import urls as U

#: Columns that a raw row may have, with their type; what is missing counts as null.
RAW = {
    "source": "string", "kind": "string", "market": "string", "title": "string", "url": "string", "image": "string", "brand": "string",
    "seller": "string", "price": "string", "currency": "string", "original_price": "string", "rating": "double", "reviews": "long",
    "sold": "string", "snippet": "string", "description": "string", "sections": "map<string,string>", "origin": "string", "gtin": "string",
    "country": "string", "sponsored": "boolean", "importer": "string",
}
#: An amount of đồng from which a price is taken for a slip of the parser.
ABSURD = 30_000_000


def _completed(raw: DataFrame) -> DataFrame:
    have = set(raw.columns)
    return raw.select(
        *(c for c in raw.columns if c not in RAW), *((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in RAW.items())
    )


def _once(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, so that the optimizer does not write a column's expression out at each mention."""
    return df.select(F.inline(F.array(F.struct(*(F.col(c) for c in df.columns)))))


def _filled(s: Column) -> Column:
    return F.when(s != "", s)


def make_items(raw: DataFrame, market: str = "vn", rates: dict[str, float] | None = None) -> DataFrame:
    """Items of raw rows; further columns of raw stay.  Prices may be numbers or texts of the row's market."""
    df = _completed(raw).withColumn("market", F.coalesce("market", F.lit(market)))
    number = F.col("price").try_cast("double")
    parsed = P.parse_price(F.col("price"), F.col("market"), F.col("currency"))
    df = _once(df.withColumn("_p", F.when(number.isNull(), parsed))).withColumn(
        "_currency", F.coalesce(F.when(number.isNull(), F.col("_p.currency")), "currency")
    )
    old = F.coalesce(
        F.col("original_price").try_cast("double"), P.parse_price(F.col("original_price"), F.col("market"), F.col("_currency"))["value"]
    )
    price = F.coalesce(number, F.col("_p.value"))
    shops = F.array(T.squash(F.col("seller")), T.squash(F.col("source")))
    own_brand = F.when((F.col("brand") != "") & ~F.array_contains(shops, T.squash(F.col("brand"))), F.col("brand"))
    df = df.select(
        *(c for c in df.columns if c not in {"_p", "_currency", "title", "price", "currency", "original_price", "brand", "seller", "rating",
                                             "reviews", "sold", "snippet", "description", "kind"}),
        T.item_id(F.col("source"), F.coalesce(_filled(F.col("url")), "title")).alias("id"),
        F.coalesce("kind", F.lit("web")).alias("kind"),
        T.clean(F.col("title")).alias("title"),
        U.host(F.col("url")).alias("domain"),
        B.normalize_brand(own_brand).alias("brand"),
        _filled(T.clean(F.col("seller"))).alias("seller"),
        price.alias("price"),
        F.col("_currency").alias("currency"),
        F.when(old > F.coalesce(price, F.lit(0.0)), old).alias("original_price"),
        F.when(F.col("rating") != 0, F.floor(F.col("rating") * 10 + 0.5) / 10).alias("rating"),
        F.when(F.col("reviews") != 0, F.col("reviews")).alias("reviews"),
        P.parse_sold(F.col("sold")).alias("sold"),
        F.when(F.col("snippet") != "", T.truncate(F.col("snippet"), 300)).alias("snippet"),
        F.when(F.col("description") != "", T.truncate(F.col("description"), 700)).alias("description"),
    )
    return finalize(_once(df), rates)


DERIVED = (
    "price_vnd", "original_price_vnd", "discount", "qty", "price_per_100_vnd", "age_months", "type", "non_food", "claims", "allergens",
    "origin_country",
)


def finalize(items: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """Items with all derived columns computed anew, as after a merge of details."""
    df = items.drop(*DERIVED)
    section = lambda name: F.element_at("sections", name)
    currency = F.coalesce("currency", F.when(F.col("price").isNotNull() & (B.country_from_url(F.col("url")) == "vn"), "VND"))
    df = _once(df.withColumn("currency", currency))
    dong = P.to_dong(F.col("price"), B.rate(F.col("currency"), rates))
    df = _once(df.withColumn("price", F.when(F.coalesce(dong <= ABSURD, F.lit(True)), F.col("price"))))
    dong = P.to_dong(F.col("price"), B.rate(F.col("currency"), rates))
    old = F.col("original_price")
    discount = F.when((old != 0) & (F.col("price") != 0), P.half_up((1 - F.col("price") / old) * 100))
    texts = lambda *c: F.concat_ws(" \n ", *(F.when(x != "", x) for x in c))
    title, snippet, description = F.col("title"), F.col("snippet"), F.col("description")
    qty = F.coalesce(P.parse_quantity(title), P.parse_quantity(section("weight")), P.parse_quantity(snippet))
    age = F.coalesce(
        P.parse_age_months(section("age")), P.parse_age_months(title),
        P.parse_age_months(texts(title, snippet, description, section("age"), section("weight"))),
    )
    kind = F.coalesce(T.first_label(title, L.TYPES), T.first_label(snippet, L.TYPES))
    ingredients = F.coalesce(section("ingredients"), F.lit(""))
    df = df.withColumns({
        "price_vnd": dong, "original_price_vnd": P.to_dong(old, B.rate(F.col("currency"), rates)), "discount": discount, "qty": qty,
        "age_months": age, "type": kind,
        "claims": T.labels_of(F.concat_ws(" ", title, snippet, description, ingredients), L.CLAIMS),
        "allergens": T.labels_of(ingredients, L.ALLERGENS),
        "brand": F.coalesce("brand", B.guess_brand(title), B.guess_brand(snippet)),
        "country": F.coalesce(
            _filled(F.col("country")), B.country_from_url(F.col("url")), B.country_from_currency(F.col("currency")), F.col("market")
        ),
        "origin_country": B.country_from_text(F.coalesce(_filled(F.col("origin")), section("origin"))),
    })
    df = _once(df)
    per_100 = F.when(
        (F.col("price_vnd") != 0) & (F.col("qty.total") >= 20), P.half_up(F.col("price_vnd") / F.col("qty.total") * 100)
    )
    return df.withColumns({"price_per_100_vnd": per_100, "non_food": F.coalesce(F.col("type") == L.NON_FOOD, F.lit(False))})


def merge_details(items: DataFrame, details: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """Items with what their detail rows (at most one an id) add; a field that an item has stays.

    Sections are merged by name, the item's own first; a price brings its currency along.
    """
    fields = ("image", "description", "rating", "reviews", "gtin", "origin", "sold", "importer")
    have = set(details.columns)

    def of(name: str, kind: str) -> Column:
        return (F.col(f"d.{name}") if name in have else F.lit(None)).cast(kind)

    kinds = dict(items.dtypes)
    joined = items.alias("i").join(details.alias("d"), "id", "left")
    added = {
        "image": of("image", "string"), "description": T.truncate(_filled(of("description", "string")), 700),
        "rating": F.floor(of("rating", "double") * 10 + 0.5) / 10, "reviews": of("reviews", "long"), "gtin": _filled(of("gtin", "string")),
        "origin": _filled(of("origin", "string")), "sold": of("sold", "long"), "importer": _filled(of("importer", "string")),
    }
    own = F.map_filter(F.coalesce("i.sections", F.create_map().cast("map<string,string>")), lambda _, v: v != "")
    extra = F.map_filter(F.coalesce(of("sections", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(own, k))
    no_price = F.col("i.price").isNull() & of("price", "double").isNotNull()
    out = {f: F.coalesce(_filled(F.col(f"i.{f}")) if kinds[f] == "string" else F.col(f"i.{f}"), F.when(F.lit(f != "description") | _filled(of("description", "string")).isNotNull(), added[f])) for f in fields}
    out |= {
        "price": F.coalesce("i.price", of("price", "double")),
        "currency": F.when(no_price, F.coalesce(of("currency", "string"), "i.currency")).otherwise(F.col("i.currency")),
        "brand": F.coalesce("i.brand", B.normalize_brand(of("brand", "string"))),
        "sections": F.map_concat(own, extra),
    }
    return finalize(_once(joined.select(*(out[c].alias(c) if c in out else F.col("id") if c == "id" else F.col(f"i.{c}") for c in items.columns))), rates)


def final_relevance(found: Column, split: Column, bonus: Column, forms: Column, form: Column, names_form: Column) -> Column:
    """An item's relevance from the match found: a shop's bonus, and what the wished product forms say.

    ``forms``: whether the query names any; ``form``: match, other or null; ``names_form``: whether the title names one.
    """
    trust = F.when(split | (forms & (found < 0.3)), 0.0).otherwise(F.coalesce(bonus, F.lit(0.0)))
    rel = F.least(F.lit(1.4), found + trust)
    shaped = (
        F.when((form == "match") & (found >= 0.3), F.least(F.lit(1.4), rel + 0.15))
        .when(form == "other", F.least(rel, F.lit(0.15)))
        .when(forms & ~names_form, F.least(rel, F.lit(0.44)))
        .otherwise(rel)
    )
    return F.floor(shaped * 100 + 0.5) / 100
