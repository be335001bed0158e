"""Captured HTML pages: products in JSON-LD, page heads, labelled sections.

Markup has no relational form, so pages are walked by the standard library's parser inside Arrow
batches; what leaves is rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from .markup import absolute, tidy

PRODUCT = (
    "page_id long, pos int, title string, url string, image string, brand string, description string, price double, currency string, "
    "availability string, rating double, reviews long, gtin string, sku string, origin string"
)
# Keys under which JSON-LD nests more objects.
NESTS = ("@graph", "itemListElement", "item", "mainEntity")


class Head(HTMLParser):
    """JSON-LD texts, meta properties, first h1 and title of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.ld: list[str] = []
        self.meta: dict[str, str] = {}
        self.text: dict[str, str] = {}
        self._open: str | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self._open = "ld"
            self.ld.append("")
        elif tag in ("h1", "title") and tag not in self.text:
            self._open = tag
            self.text[tag] = ""
        elif tag == "meta":
            name = a.get("property") or a.get("itemprop") or a.get("name")
            if name and a.get("content"):
                self.meta.setdefault(name.lower(), a["content"])

    def handle_endtag(self, tag):
        if tag in ("script", "h1", "title"):
            self._open = None

    def handle_data(self, data):
        if self._open == "ld":
            self.ld[-1] += data
        elif self._open:
            self.text[self._open] += data


def _walk(value, depth: int = 0) -> Iterator[dict]:
    if depth > 40:
        return
    if isinstance(value, list):
        for v in value:
            yield from _walk(v, depth + 1)
    elif isinstance(value, dict):
        yield value
        for k in NESTS:
            if k in value:
                yield from _walk(value[k], depth + 1)


def _first(value):
    while isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, dict):
        value = value.get("name") or value.get("url")
    return str(value) if value not in (None, "") else None


def _number(value):
    try:
        n = float(str(value).replace(",", "."))
    except ValueError:
        return None
    return n if n > 0 else None


def ld_values(texts: Iterable[str]) -> Iterator[dict]:
    """Objects in JSON-LD texts and nested in them; trailing commas and raw control characters are forgiven."""
    for text in texts:
        text = text.strip().rstrip(";")
        try:
            data = json.loads(text, strict=False)
        except ValueError:
            try:
                data = json.loads(re.sub("[\x00-\x1f]+", " ", re.sub(r",\s*([}\]])", r"\1", text)))
            except ValueError:
                continue
        yield from _walk(data)


def is_kind(o: dict, kind: str) -> bool:
    kinds = o.get("@type")
    return any(str(k).lower() == kind for k in (kinds if isinstance(kinds, list) else [kinds]))


def _list(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _amount(value) -> float | None:
    """A price's digits and dots as a number; 0 counts as none."""
    try:
        return float(re.sub("[^0-9.]", "", str(value))) or None
    except ValueError:
        return None


def _of(value, *names: str):
    return next((value[n] for n in names if value.get(n) not in (None, "")), None) if isinstance(value, dict) else None


def ld_product(o: dict, base: str | None) -> dict:
    """The row of a named Product object; the first offer with a price tells it, offers may be nested in one."""
    offers = [x for offer in _list(o.get("offers")) for x in (_list(offer["offers"]) if isinstance(offer, dict) and offer.get("offers") else [offer])]
    offers = [x for x in offers if isinstance(x, dict)]
    offer = next((x for x in offers if x.get("price") or x.get("lowPrice")), offers[0] if offers else {})
    terms = _first_object(offer.get("priceSpecification"))
    rating = o.get("aggregateRating")
    currency, stock = _of(offer, "priceCurrency") or _of(terms, "priceCurrency"), _of(offer, "availability")
    reviews = _number(_of(rating, "reviewCount") or _of(rating, "ratingCount"))
    image = _first_object(o.get("image"))
    image = _of(image, "url", "contentUrl") if isinstance(image, dict) else image
    return {
        "title": tidy(_first(o.get("name"))), "url": absolute(_first(o.get("url")) or _first(o.get("@id")) or _first(offer.get("url")), base),
        "image": absolute(_first(image), base), "brand": tidy(_first(o.get("brand"))) or None, "description": tidy(_first(o.get("description"))) or None,
        "price": _amount(_of(offer, "price", "lowPrice") or _of(terms, "price")), "currency": str(currency).upper() if currency else None,
        "availability": str(stock).split("/")[-1] if stock else None, "rating": _number(_of(rating, "ratingValue")),
        "reviews": int(reviews) if reviews else None,
        "gtin": next((_first(o[k]) for k in ("gtin13", "gtin", "gtin8", "gtin12", "gtin14") if o.get(k)), None),
        "sku": _first(o.get("sku")), "origin": tidy(_first(o.get("countryOfOrigin"))) or None,
    }


def _first_object(value):
    while isinstance(value, list):
        value = value[0] if value else None
    return value


def ld_products(html: str | None, base: str | None) -> list[dict]:
    """All named Product objects of a page's JSON-LD."""
    head = Head()
    head.feed(html or "")
    return [ld_product(o, base) for o in ld_values(head.ld) if is_kind(o, "product") and _first(o.get("name"))]


def products(pages: DataFrame) -> DataFrame:
    """Rows of pages(page_id, url, html), one for each product in their JSON-LD."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in PRODUCT.split(", ")]
        for pdf in batches:
            rows = [
                {"page_id": i, "pos": n, **p}
                for i, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True)
                for n, p in enumerate(ld_products(html, url))
            ]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"page_id": "int64", "pos": "int32", "price": "float64", "rating": "float64", "reviews": "Int64"})

    return pages.select("page_id", "url", "html").mapInPandas(run, PRODUCT)
