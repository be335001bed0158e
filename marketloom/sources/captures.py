"""Captured answers of product sources, as listing rows.

A capture is a table (source, market, payload): the JSON text a source answered with.  A connector says
where its records lie in the payload and which expression of a record gives each field; fetching is
not this engine's matter.  All connectors are projections inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.price import parse_sold
from ..functions.text import bound, clean, item_id, text_from_html, truncate
from ..operators.rows import first_wins

#: What every connector gives; what it does not know is null.
FIELDS = {
    "title": "string", "url": "string", "image": "string", "price": "double", "price_text": "string", "currency": "string",
    "originalPrice": "double", "brand": "string", "seller": "string", "rating": "double", "reviews": "long", "sold": "long",
    "origin": "string", "gtin": "string", "snippet": "string", "description": "string", "sponsored": "boolean",
}


def at(path: str) -> Column:
    """A string inside the record; empty counts as missing."""
    return F.nullif(F.get_json_object("record", f"$.{path}"), F.lit(""))


def num(path: str) -> Column:
    """A number inside the record; 0 counts as missing."""
    return F.nullif(at(path).try_cast("double"), F.lit(0.0))


def joined(separator: str, *parts: Column) -> Column:
    return F.nullif(F.concat_ws(separator, *parts), F.lit(""))


def prefixed(prefix: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(prefix), value))


def above(value: Column, other: Column) -> Column:
    return F.when(value > other, value)


@dataclass(frozen=True)
class Connector:
    id: str
    kind: str
    markets: tuple[str, ...]
    #: Paths of record arrays in a payload; a path through an array of groups ends in [*].
    records: tuple[str, ...]
    fields: Mapping[str, Callable[[], Column]]
    keep: Callable[[], Column] = field(default=lambda: at("title").isNotNull() | F.lit(True))
    #: The payload's JSON, where it lies inside a page.
    json: Callable[[Column], Column] = field(default=lambda payload: payload)
    #: Of equal keys the first record stays, a null key drops the record; told inside the payload, without a shuffle.
    unique: Callable[[Column], Column] | None = None


EVERYWHERE = ("*",)
PRICE_IN_TEXT = r"(?:[$€£₫¥]\s?[0-9][0-9.,]*|[0-9][0-9.,]*\s?(?:₫|đ|VND|USD|EUR|€|£))"


def _price_text(*paths: str) -> Column:
    return F.nullif(F.regexp_extract(F.concat_ws(" ", *map(at, paths)), PRICE_IN_TEXT, 0), F.lit(""))


def _nested(field_: str, path: str) -> Column:
    """A value of JSON text inside a record's field, or of the object that stands there."""
    return F.nullif(F.get_json_object(at(field_), f"$.{path}"), F.lit(""))


def _key_of(record: Column, key: str, needed: tuple[str, ...], unwanted: str | None = None) -> Column:
    """A record's key; null without what a row needs, or where a flag says that it is an advertisement."""
    get = lambda name: F.get_json_object(record, f"$.{name}")
    ok = F.lit(True)
    for name in needed:
        ok = ok & (F.coalesce(get(name), F.lit("")) != "")
    if unwanted:
        ok = ok & ~F.coalesce(get(unwanted), F.lit("")).isin("true", "1")
    return F.when(ok, get(key))


def _page_data(page: Column) -> Column:
    """The state object of a page built by a common script framework."""
    return F.regexp_extract(page, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)


def _inline_objects(page: Column) -> Column:
    """All flat objects under one name in a page, as a JSON list; what is no JSON is left out."""
    found = F.regexp_extract_all(page, F.lit(r'"brazeData":\s*(\{[^{}]*\})'), F.lit(1))
    whole = F.filter(found, lambda o: F.try_parse_json(o).isNotNull())
    return F.concat(F.lit("["), F.array_join(whole, ","), F.lit("]"))


def _asda_title() -> Column:
    """Brand and name; a name that opens with the brand is dropped, as the site's own titles do."""
    brand, name = at("BRAND"), at("NAME")
    return clean(F.when(F.startswith(F.lower(name), F.lower(brand)), brand).otherwise(F.concat_ws(" ", brand, name)))


def _dashed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")


# Hosts and currencies of one marketplace's countries.
LAZADA = {
    "vn": ("www.lazada.vn", "VND"), "th": ("www.lazada.co.th", "THB"), "sg": ("www.lazada.sg", "SGD"), "my": ("www.lazada.com.my", "MYR"),
    "ph": ("www.lazada.com.ph", "PHP"), "id": ("www.lazada.co.id", "IDR"),
}


def _of_market(i: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for market, values in LAZADA.items() for x in (market, values[i]))), F.col("market"))


CONNECTORS: dict[str, Connector] = {
    c.id: c
    for c in (
        Connector("tiki", "shop", ("vn",), ("data",), {
            "title": lambda: at("name"),
            "url": lambda: prefixed("https://tiki.vn/", F.coalesce(at("url_path"), F.concat(at("url_key"), F.lit(".html")))),
            "image": lambda: at("thumbnail_url"), "price": lambda: num("price"), "currency": lambda: F.lit("VND"),
            "originalPrice": lambda: num("original_price"), "brand": lambda: at("brand_name"), "seller": lambda: at("seller_name"),
            "rating": lambda: num("rating_average"), "reviews": lambda: num("review_count"), "sold": lambda: at("quantity_sold.value").try_cast("double"),
            "origin": lambda: at("origin"), "gtin": lambda: F.when(at("sku").rlike("^[0-9]{8,14}$"), at("sku")),
        }),
        Connector("naver", "shop", ("kr",), ("items",), {
            "title": lambda: clean(text_from_html(at("title"))), "url": lambda: at("link"), "image": lambda: at("image"),
            "price": lambda: num("lprice"), "currency": lambda: F.lit("KRW"), "brand": lambda: F.coalesce(at("brand"), at("maker")),
            "seller": lambda: F.coalesce(at("mallName"), F.lit("Naver Shopping")),
            "snippet": lambda: joined(" > ", *(at(f"category{i}") for i in (1, 2, 3, 4))),
        }, lambda: at("title").isNotNull() & at("link").isNotNull()),
        Connector("gshop", "shop", EVERYWHERE, ("shopping",), {
            "title": lambda: at("title"), "url": lambda: at("link"), "image": lambda: at("imageUrl"), "price_text": lambda: at("price"),
            "seller": lambda: at("source"), "rating": lambda: num("rating"), "reviews": lambda: num("ratingCount"), "snippet": lambda: at("delivery"),
        }),
        Connector("google", "web", EVERYWHERE, ("organic",), {
            "title": lambda: at("title"), "url": lambda: at("link"), "snippet": lambda: at("snippet"), "image": lambda: at("imageUrl"),
            "price_text": lambda: F.coalesce(at("price"), at("priceRange")), "rating": lambda: num("rating"), "reviews": lambda: num("ratingCount"),
        }),
        Connector("searxng", "web", EVERYWHERE, ("results",), {
            "title": lambda: at("title"), "url": lambda: at("url"), "snippet": lambda: at("content"),
            "image": lambda: F.coalesce(at("img_src"), at("thumbnail")), "price_text": lambda: _price_text("title", "content"),
        }),
        Connector("brave", "web", EVERYWHERE, ("web.results",), {
            "title": lambda: F.regexp_replace(at("title"), "</?strong>", ""), "url": lambda: at("url"),
            "snippet": lambda: F.regexp_replace(at("description"), "</?strong>", ""), "image": lambda: at("thumbnail.src"),
            "price_text": lambda: F.coalesce(at("product.price"), _price_text("title", "description")),
        }),
        Connector("target", "shop", ("us",), ("data.search.products",), {
            "title": lambda: clean(text_from_html(at("item.product_description.title"))), "url": lambda: at("item.enrichment.buy_url"),
            "image": lambda: at("item.enrichment.image_info.primary_image.url"), "brand": lambda: at("item.primary_brand.name"),
            "price": lambda: num("price.current_retail"), "price_text": lambda: at("price.formatted_current_price"),
            "originalPrice": lambda: above(num("price.reg_retail"), num("price.current_retail")), "currency": lambda: F.lit("USD"),
            "rating": lambda: num("ratings_and_reviews.statistics.rating.average"), "reviews": lambda: num("ratings_and_reviews.statistics.rating.count"),
            "sponsored": lambda: F.coalesce(at("is_sponsored_sku") == "true", F.lit(False)), "seller": lambda: F.lit("Target"), "gtin": lambda: at("item.primary_barcode"),
        }, lambda: at("item.product_description.title").isNotNull()),
        Connector("woolworths", "shop", ("au",), ("Products[*].Products",), {
            "title": lambda: F.coalesce(at("DisplayName"), at("Name")),
            "url": lambda: F.concat(F.lit("https://www.woolworths.com.au/shop/productdetails/"), at("Stockcode"), F.lit("/"), F.coalesce(at("UrlFriendlyName"), F.lit(""))),
            "image": lambda: F.coalesce(at("MediumImageFile"), at("SmallImageFile")), "brand": lambda: at("Brand"),
            "price": lambda: F.coalesce(num("Price"), num("InstorePrice")), "originalPrice": lambda: above(num("WasPrice"), num("Price")),
            "currency": lambda: F.lit("AUD"), "gtin": lambda: at("Barcode"), "snippet": lambda: at("CupString"), "seller": lambda: F.lit("Woolworths"),
        }, lambda: F.coalesce(at("DisplayName"), at("Name")).isNotNull()),
        Connector("dm", "shop", ("de",), ("products",), {
            "title": lambda: joined(" ", at("brandName"), at("title")), "url": lambda: prefixed("https://www.dm.de", at("tileData.self")),
            "image": lambda: at("tileData.images[0].tileSrc"), "brand": lambda: at("brandName"), "price": lambda: num("tileData.price.price.current.value"),
            "currency": lambda: F.lit("EUR"), "gtin": lambda: at("gtin"), "snippet": lambda: at("tileData.title.subheadline"),
            "rating": lambda: num("tileData.rating.ratingValue"), "reviews": lambda: num("tileData.rating.ratingCount"), "seller": lambda: F.lit("dm"),
        }),
        Connector("fairprice", "shop", ("sg",), ("data.product",), {
            "title": lambda: at("name"), "url": lambda: prefixed("https://www.fairprice.com.sg/product/", at("slug")), "image": lambda: at("images[0]"),
            "brand": lambda: at("brand.name"),
            "price": lambda: F.coalesce(at("final_price").try_cast("double"), num("storeSpecificData[0].mrp") - F.coalesce(num("storeSpecificData[0].discount"), F.lit(0.0))),
            "originalPrice": lambda: F.when(num("storeSpecificData[0].discount").isNotNull(), num("storeSpecificData[0].mrp")),
            "currency": lambda: F.lit("SGD"), "gtin": lambda: at("barcodes[0]"), "seller": lambda: F.lit("FairPrice"), "origin": lambda: at("metaData['Country of Origin']"),
            "description": lambda: truncate(text_from_html(at("metaData['Key Information']")), 600),
        }),
        Connector("kurly", "shop", ("kr",), ("data.listSections[*].data.items",), {
            "title": lambda: clean(at("name")), "url": lambda: prefixed("https://www.kurly.com/goods/", at("no")), "image": lambda: at("listImageUrl"),
            "price": lambda: F.coalesce(at("discountedPrice"), at("salesPrice")).try_cast("double"),
            "originalPrice": lambda: above(num("salesPrice"), num("discountedPrice")), "currency": lambda: F.lit("KRW"),
            "reviews": lambda: F.regexp_replace(at("reviewCount"), "[^0-9]", "").try_cast("double"), "snippet": lambda: at("shortDescription"), "seller": lambda: F.lit("Kurly"),
        }, lambda: at("no").isNotNull() & at("name").isNotNull()),
        Connector("prenatal", "shop", ("it",), ("hits",), {
            "title": lambda: clean(at("title")), "url": lambda: at("permalink"), "image": lambda: F.coalesce(at("image_url"), at("images[0].src")),
            "price": lambda: F.coalesce(at("analytics_item.price").try_cast("double"), at("price.min").try_cast("double") / 100),
            "originalPrice": lambda: above(num("regular_price.min") / 100, F.coalesce(num("analytics_item.price"), num("price.min") / 100)),
            "currency": lambda: F.lit("EUR"), "brand": lambda: F.coalesce(at("brand.name"), at("form.brand.name")), "gtin": lambda: at("form.ean"),
            "rating": lambda: F.when(num("rating_count") > 0, num("average_rating")), "reviews": lambda: num("rating_count"), "sold": lambda: num("total_sales"),
            "snippet": lambda: at("unit_data.per_unit_price_label"), "description": lambda: clean(text_from_html(at("short_description"))), "seller": lambda: F.lit("Prenatal"),
        }, lambda: at("title").isNotNull() & at("permalink").isNotNull()),
        Connector("efarma", "shop", ("it",), ("hits",), {
            "title": lambda: clean(at("name")), "url": lambda: at("url"), "image": lambda: F.coalesce(at("image_url"), at("thumbnail_url")),
            "price": lambda: num("price.EUR.default"), "originalPrice": lambda: above(num("price.EUR.default_original"), num("price.EUR.default")), "currency": lambda: F.lit("EUR"),
            "brand": lambda: F.coalesce(at("brand"), at("manufacturer")), "gtin": lambda: at("ean"),
            "rating": lambda: F.when(num("rating_count") > 0, num("rating_summary") / 20), "reviews": lambda: num("rating_count"),
            "sold": lambda: F.floor(num("total_ordered") + 0.5), "description": lambda: clean(text_from_html(at("characteristics"))), "seller": lambda: F.lit("eFarma"),
        }, lambda: at("name").isNotNull() & at("url").isNotNull()),
        Connector("boots", "shop", ("gb",), ("hits",), {
            "title": lambda: clean(at("offerName")), "url": lambda: prefixed("https://www.boots.com", at("actionURL")),
            "image": lambda: F.coalesce(at("referenceImageURL"), at("thumbnailImage")), "price": lambda: num("currentPrice"),
            "originalPrice": lambda: above(num("regularPrice"), num("currentPrice")), "currency": lambda: F.lit("GBP"), "brand": lambda: at("brand"), "gtin": lambda: at("upc"),
            "rating": lambda: F.when(num("numberOfReviews") > 0, F.round(num("averageReviewScore"), 1)), "reviews": lambda: num("numberOfReviews"),
            "snippet": lambda: joined(" · ", at("ppuVolume"), at("pricePerUnit")), "seller": lambda: F.lit("Boots"),
        }, lambda: at("offerName").isNotNull() & at("actionURL").isNotNull()),
        Connector("sainsburys", "shop", ("gb",), ("products",), {
            "title": lambda: at("name"), "url": lambda: prefixed("https", F.regexp_replace(at("full_url"), "^https?", "")), "image": lambda: at("image"),
            "price": lambda: at("retail_price.price").try_cast("double"), "originalPrice": lambda: at("promotions[0].original_price").try_cast("double"),
            "currency": lambda: F.lit("GBP"), "rating": lambda: num("reviews.average_rating"), "reviews": lambda: num("reviews.total"),
            "gtin": lambda: at("eans[0]"), "seller": lambda: F.lit("Sainsbury's"),
        }),
        Connector("11st", "shop", ("kr",), ("data[*].items",), {
            "title": lambda: clean(at("title")), "url": lambda: prefixed("https://www.11st.co.kr/products/", at("id")), "image": lambda: at("imageUrl"),
            "price": lambda: num("finalPrc"), "originalPrice": lambda: above(num("selPrc"), num("finalPrc")), "currency": lambda: F.lit("KRW"),
            "brand": lambda: at("brandEngNm"), "rating": lambda: num("satisfactionScore"), "sold": lambda: num("saleCnt"),
            "reviews": lambda: F.nullif(F.regexp_replace(at("reviewCountText"), "[^0-9]", "").try_cast("double"), F.lit(0.0)),
            "seller": lambda: F.concat_ws(" · ", F.lit("11번가"), at("sellerNickName")),
        }, unique=lambda r: _key_of(r, "id", ("id", "title", "finalPrc"), "adProduct")),
        Connector("asda", "shop", ("gb",), ("hits",), {
            "title": _asda_title,
            "url": lambda: F.concat(
                F.lit("https://www.asda.com/groceries/product/"),
                _dashed(F.coalesce(_nested("PRIMARY_TAXONOMY", "AISLE_NAME"), _nested("PRIMARY_TAXONOMY", "DEPT_NAME"), F.lit("groceries"))), F.lit("/"),
                F.regexp_replace(_dashed(_asda_title()), "^-|-$", ""), F.lit("/"), at("CIN"),
            ),
            "image": lambda: F.concat(F.lit("https://asdagroceries.scene7.com/is/image/asdagroceries/"), at("IMAGE_ID"), F.lit("?$ProdListProd$")),
            "price": lambda: F.coalesce(_nested("PRICES", "EN.PRICE"), _nested("PRICES", "*.PRICE")).try_cast("double"), "currency": lambda: F.lit("GBP"),
            "brand": lambda: at("BRAND"), "rating": lambda: F.when(num("AVG_RATING") > 0, F.floor(num("AVG_RATING") * 10 + 0.5) / 10), "reviews": lambda: num("RATING_COUNT"),
            "snippet": lambda: joined(" · ", at("PACK_SIZE"), _nested("PRICES", "EN.PRICEPERUOMFORMATTED")), "seller": lambda: F.lit("Asda"),
            "sponsored": lambda: F.coalesce(at("IS_SPONSORED") == "true", F.lit(False)),
        }, lambda: at("NAME").isNotNull() & at("CIN").isNotNull() & (F.coalesce(at("DISPLAY_ONLINE"), F.lit("")) != "false")),
        Connector("shoppers", "shop", ("ca",), (
            "props.pageProps.viewDefinitionResults.viewDefinition.layout.sections.mainContentCollection.components[*].data.productTiles",
        ), {
            "title": lambda: clean(at("title")), "url": lambda: prefixed("https://shop.shoppersdrugmart.ca", F.split_part(at("link"), F.lit("?"), F.lit(1))),
            "image": lambda: F.coalesce(at("productImage[0].mediumUrl"), at("productImage[0].imageUrl")), "price": lambda: num("pricing.price"),
            "currency": lambda: F.lit("CAD"), "brand": lambda: at("brand"), "rating": lambda: at("ratings.average_rating").try_cast("double"),
            "reviews": lambda: at("ratings.review_count").try_cast("long"), "snippet": lambda: at("pricingUnits.unit"), "seller": lambda: F.lit("Shoppers Drug Mart"),
        }, json=_page_data, unique=lambda r: _key_of(r, "productId", ("title", "link"), "isSponsored")),
        Connector("lotteon", "shop", ("kr",), ("",), {
            "title": lambda: clean(at("spdNm")), "url": lambda: prefixed("https://www.lotteon.com/p/product/", at("spdNo")), "image": lambda: at("image"),
            "price": lambda: F.coalesce(num("discountPrice"), num("price")), "originalPrice": lambda: above(num("price"), F.coalesce(num("discountPrice"), F.lit(0.0))),
            "currency": lambda: F.lit("KRW"), "brand": lambda: at("brandName"), "rating": lambda: F.when(num("reviewCount") > 0, num("reviewScore")),
            "reviews": lambda: num("reviewCount"), "seller": lambda: F.lit("Lotte ON"),
        }, json=_inline_objects, unique=lambda r: _key_of(r, "spdNo", ("spdNm", "spdNo"))),
        Connector("lazada", "shop", tuple(LAZADA), ("mods.listItems",), {
            "title": lambda: at("name"),
            "url": lambda: F.split_part(F.when(at("itemUrl").startswith("//"), F.concat(F.lit("https:"), at("itemUrl"))).when(at("itemUrl").rlike("^https?:"), at("itemUrl"))
                                        .otherwise(F.concat(F.lit("https://"), _of_market(0), at("itemUrl"))), F.lit("?"), F.lit(1)),
            "image": lambda: at("image"), "price": lambda: at("price").try_cast("double"), "price_text": lambda: at("priceShow"), "currency": lambda: _of_market(1),
            "originalPrice": lambda: num("originalPrice"), "brand": lambda: at("brandName"), "seller": lambda: at("sellerName"), "rating": lambda: num("ratingScore"),
            "reviews": lambda: num("review"), "sold": lambda: parse_sold(at("itemSoldCntShow")),
            "sponsored": lambda: F.coalesce(at("isSponsored"), F.lit("")).isin("true", "1") | F.coalesce(at("adFlag"), F.lit("")).isin("true", "1"),
        }),
        Connector("off", "db", EVERYWHERE, ("hits",), {
            "title": lambda: clean(F.coalesce(at("product_name_vi"), at("product_name"), at("product_name_en"))),
            "url": lambda: prefixed("https://world.openfoodfacts.org/product/", at("code")), "image": lambda: F.coalesce(at("image_front_url"), at("image_front_small_url")),
            "brand": lambda: F.split_part(F.coalesce(at("brands[0]"), at("brands")), F.lit(","), F.lit(1)), "snippet": lambda: at("generic_name"), "gtin": lambda: at("code"),
        }, lambda: at("code").isNotNull() & F.coalesce(at("product_name"), at("product_name_en")).isNotNull()),
    )
}


def _records(path: str) -> Column:
    """The records under one path of the payload, as JSON texts."""
    groups, _, rest = path.partition("[*].")
    top = F.from_json(F.get_json_object("payload", f"$.{groups}") if groups else F.col("payload"), "array<string>")
    if not rest:
        return top
    inner = F.transform(top, lambda g: F.from_json(F.get_json_object(g, f"$.{rest}"), "array<string>"))
    return F.flatten(F.filter(inner, lambda a: a.isNotNull()))


def _found(c: Connector) -> Column:
    """A payload's records of one source in their order, as JSON texts."""
    records = F.concat(*(F.coalesce(_records(p), F.array().cast("array<string>")) for p in c.records))
    if not c.unique:
        return records
    keyed = F.transform(records, lambda r: F.struct(c.unique(r).alias("key"), r.alias("record")))
    return bound(keyed, lambda k: F.transform(
        F.filter(k, lambda x, i: x["key"].isNotNull() & (F.array_position(k["key"], x["key"]) == i + 1)), lambda x: x["record"]
    ))


def by_source(choices: Mapping[str, Column]) -> Column:
    """The expression of the row's own source; the others are not evaluated."""
    out = None
    for source, value in choices.items():
        case = F.col("source") == source
        out = F.when(case, value) if out is None else out.when(case, value)
    return out


def _read(captures: DataFrame, connectors: Sequence[Connector], more: Sequence[str], only: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    known = captures.where(F.col("source").isin(*(c.id for c in connectors)))
    rows = known.select("source", "market", *more, by_source({c.id: c.json(F.col("payload")) for c in connectors}).alias("payload"))
    rows = rows.select("source", "market", *more, F.posexplode(by_source({c.id: _found(c) for c in connectors})).alias("pos", "record"))
    rows = rows.where(by_source({c.id: c.keep() for c in connectors}))
    fields = []
    for name, kind in FIELDS.items():
        if name not in only:
            continue
        given = {c.id: c.fields[name]().cast(kind) for c in connectors if name in c.fields}
        fields.append((by_source(given) if given else F.lit(None).cast(kind)).alias(name))
    kind = by_source({c.id: F.lit(c.kind) for c in connectors}).alias("kind")
    out = rows.select("source", kind, "market", *more, "pos", *fields)
    return out.withColumn("id", item_id(F.col("source"), F.coalesce("url", "title")))


def read(captures: DataFrame, source: str) -> DataFrame:
    """Listing rows of one source's captures(source, market, payload), with their position."""
    return _read(captures, [CONNECTORS[source]], ())


def read_all(captures: DataFrame) -> DataFrame:
    """Rows of every known source: one pass over the captures, each row read by its source's connector alone."""
    return _read(captures, list(CONNECTORS.values()), ())


def read_pages(captures: DataFrame, only: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """``read_all`` of captures(source, market, query, page, payload) whose searches came in several pages.

    Of a search's rows with one url the first by page and position stays, so a product that two pages list is one row; rows
    without a url all stay.  ``only`` names the fields that are wanted beside url and title: a row is sorted with all that it holds.
    """
    rows = _read(captures, list(CONNECTORS.values()), ("query", "page"), ("url", "title", *only))
    # one pass: a row without a url is a key of its own
    own = F.when(F.col("url").isNull(), F.monotonically_increasing_id())
    return first_wins(rows.withColumn("__own", own), ["source", "market", "query", "url", "__own"], ["page", "pos"]).drop("__own")
