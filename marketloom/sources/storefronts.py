"""Listing pages of shops that answer in markup: JSON-LD, then state objects, then product cards.

A page is read once, in Arrow batches, to raw rows of all three ways with prices as text; prices are parsed in the JVM,
and per page one way is chosen: JSON-LD or state objects where they give at least ``LEAST`` rows, else the cards, or
JSON-LD where it gives more than those.  Only rows are shuffled, by page; markup stays where it is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.price import parse_price
from ..functions.text import item_id
from . import markup, pages, state
from .batches import flat_rows
from .captures import FIELDS

#: Rows that a way needs to be trusted before the next is looked at.
LEAST = 3
_RAW = (
    "page_id long, way int, pos int, title string, url string, image string, brand string, price double, prices array<string>, currency string, "
    "description string, rating double, reviews long, gtin string, origin string"
)


@dataclass(frozen=True)
class Shop:
    """A shop's fixed values; ``mixed`` marks pages that also show products nobody asked for."""

    id: str
    name: str
    market: str
    currency: str
    mixed: bool = False


# Shops whose result pages are read this way.
SHOPS = {
    s.id: s
    for s in (
        Shop("concung", "Con Cưng", "vn", "VND"), Shop("kidsplaza", "Kids Plaza", "vn", "VND"), Shop("walmart", "Walmart", "us", "USD"),
        Shop("iherb", "iHerb", "us", "USD", True), Shop("coles", "Coles", "au", "AUD"), Shop("coupang", "Coupang", "kr", "KRW"),
        Shop("monoprix", "Monoprix", "fr", "EUR", True), Shop("shopapotheke", "Shop Apotheke", "de", "EUR", True),
        Shop("farmae", "Farmaè", "it", "EUR", True), Shop("farmaciaigea", "Farmacia Igea", "it", "EUR", True),
        Shop("amicafarmacia", "Amica Farmacia", "it", "EUR", True), Shop("yahoojp", "Yahoo!ショッピング", "jp", "JPY", True),
        Shop("ssg", "SSG.COM", "kr", "KRW", True), Shop("wellca", "Well.ca", "ca", "CAD", True),
        Shop("walmartca", "Walmart Canada", "ca", "CAD", True), Shop("loblaws", "Loblaws", "ca", "CAD", True),
    )
}


def raw_rows(html: str | None, base: str | None) -> Iterator[dict]:
    """Rows of one page with the way that gave them: 0 JSON-LD, 1 state objects, 2 cards."""
    page = markup.Page(html)
    texts = [text for kind, text in page.scripts() if kind == "application/ld+json"]
    named = [pages.ld_product(o, base) for o in pages.ld_values(texts) if pages.is_kind(o, "product") and o.get("name")]
    for way, rows in enumerate(([p for p in named if p["url"]], state.products(state.blobs(page), base), markup.cards(page, base))):
        for pos, row in enumerate(rows):
            yield {"way": way, "pos": pos, "prices": [], **row}


def listing(captured: DataFrame, least: int = LEAST, carried: Sequence[str] = ()) -> DataFrame:
    """Product rows of captured(page_id, url, html): page_id, pos, way, title, url, image, price, currency, originalPrice and their like.

    A card's price is the lowest of its prices, the highest is what it was before; state objects need a price.  A page
    without products gives no row.  page_id must tell pages apart.  ``carried`` names string columns of the pages that
    their rows keep.
    """
    carried = list(carried)
    schema = ", ".join([_RAW, *(f"{c} string" for c in carried)])

    def read_page(page: dict) -> Iterator[dict]:
        kept = {c: page[c] for c in ("page_id", *carried)}
        return (kept | row for row in raw_rows(page["html"], page["url"]))

    rows = flat_rows(captured.select("page_id", "url", "html", *carried), read_page, schema)
    # a state object's text is read as its own currency's, in dollars where that says nothing; a card's in dong, the home market's
    market = F.when(F.col("way") == 1, F.lit("us")).otherwise(F.lit("vn"))
    parsed = F.filter(F.transform("prices", lambda p: parse_price(p, market, F.when(F.col("way") == 1, F.col("currency")))), lambda p: p.isNotNull())
    # parsed before the shuffle, so that what follows reads it as a column
    rows = rows.withColumn("parsed", F.array_sort(parsed)).repartition("page_id")
    low, high = F.get("parsed", F.lit(0)), F.element_at(F.col("parsed"), -1)
    some = F.size("parsed") > 0
    rows = rows.withColumns({
        "price": F.coalesce("price", F.when(some, low["value"])),
        "currency": F.coalesce(F.when(F.col("way") == 2, F.when(some, low["currency"])), F.upper("currency"), F.when(some, low["currency"])),
        "originalPrice": F.when(some & (F.col("way") == 2), F.when(high["value"] > low["value"], high["value"])),
    })
    page = Window.partitionBy("page_id")
    same = Window.partitionBy("page_id", "way", F.when(F.col("way") == 1, F.struct("title", "price"))).orderBy("pos")
    # state objects need a price, and equal title and price count once; the other ways keep their rows
    rows = rows.withColumn("nth", F.row_number().over(same)).where((F.col("way") != 1) | (F.col("nth") == 1) & F.col("price").isNotNull())
    n = [F.sum(F.when(F.col("way") == w, 1).otherwise(0)).over(page) for w in range(3)]
    best = F.when(n[0] >= least, 0).when(n[1] >= least, 1).when(n[0] > n[2], 0).otherwise(2)
    order = Window.partitionBy("page_id").orderBy("pos")
    return (
        rows.withColumn("best", best)
        .where("way = best")
        .withColumn("pos", F.row_number().over(order) - 1)
        .drop("nth", "best", "prices", "parsed")
    )


def read(captures: DataFrame) -> DataFrame:
    """Listing rows of captures(source, market, url, payload) of all shops known here, with the connectors' columns.

    A row without a currency takes its shop's; the seller is the shop.  Each capture is a page of its own.
    """
    known = captures.where(F.col("source").isin(*SHOPS)).select(
        F.monotonically_increasing_id().alias("page_id"), "source", "market", "url", F.col("payload").alias("html")
    )

    def of_shop(value: Callable[[Shop], str]) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for s in SHOPS.values() for x in (s.id, value(s)))), F.col("source"))

    rows = listing(known, carried=("source", "market")).withColumns(
        {"currency": F.coalesce("currency", of_shop(lambda s: s.currency)), "seller": of_shop(lambda s: s.name)}
    )
    fields = [(F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name) for name, kind in FIELDS.items()]
    out = rows.select("source", F.lit("shop").alias("kind"), "market", "pos", *fields)
    return out.withColumn("id", item_id(F.col("source"), F.coalesce("url", "title")))
