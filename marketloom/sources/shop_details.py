"""Captured product pages in markup of shops with a form of their own, as detail rows for ``items.merge_details``.

captures(id, source, payload) give the columns of ``details`` and the importer.  What a page lacks is null; a page that is
none of the shop's, or null, gives a row of nulls.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.price import plain_price
from ..functions.text import clean, text_from_html, truncate, unglue
from .batches import flat_rows
from .details import FIELDS
from .markup import Page
from .pages import ld_values
from .product_pages import fragment_text
from .sections import importer, sections_of

_RAW = "id string, source string, prices array<string>, told string, sections map<string,string>"


def json_string(text: str, key: str) -> str:
    """The first JSON string under a key in a text that holds JSON somewhere."""
    m = re.search(rf'"{re.escape(key)}":("(?:[^"\\]|\\.)*")', text)
    try:
        return json.loads(m[1]) if m else ""
    except ValueError:
        return ""


def _lazada(html: str) -> dict:
    """The seller's description, and the sections of it and of the highlights."""
    told = json_string(html, "desc")
    found = sections_of(fragment_text(f"{json_string(html, 'highlights')}\n{told}")) if told else {}
    return {"told": told or None, "sections": list(found.items())}


def _auchan(html: str) -> dict:
    """Prices in the order of their rank: the marked one, then those of offers in JSON-LD."""
    page = Page(html)
    marked = [page.attrs[i].get("content") for i in page.under() if page.attrs[i].get("itemprop") == "price"][:1]
    linked = [text for kind, text in page.scripts() if "ld+json" in kind]
    offers = [o for value in ld_values(linked) for o in _listed(value.get("offers"))]
    prices = [next((str(o[n]) for n in ("price", "lowPrice") if o.get(n) is not None), None) for o in offers if isinstance(o, dict)]
    return {"prices": [p for p in (*marked, *prices) if p]}


def _listed(value) -> list:
    return value if isinstance(value, list) else [value]


READERS: dict[str, Callable[[str], dict]] = {"lazada": _lazada, "auchan": _auchan}
CURRENCY = {"auchan": "EUR"}


def read(captures: DataFrame) -> DataFrame:
    """Detail rows of the shops known here, in one pass without a shuffle; a price of 0 counts as missing."""

    def rows(capture: dict) -> Iterator[dict]:
        yield {"id": capture["id"], "source": capture["source"], **READERS[capture["source"]](capture["payload"] or "")}

    known = captures.where(F.col("source").isin(*READERS)).select(F.col("id").cast("string").alias("id"), "source", "payload")
    raw = flat_rows(known, rows, _RAW)
    prices = F.filter(F.transform("prices", plain_price), lambda p: p.isNotNull())
    price = F.nullif(F.get(prices, F.lit(0)), F.lit(0.0))
    currency = F.when(price.isNotNull(), F.when(F.col("source") == "auchan", F.lit(CURRENCY["auchan"])))
    told = text_from_html(F.col("told"))
    given = {
        "price": price, "currency": currency, "description": F.nullif(truncate(clean(told), 600), F.lit("")),
        "sections": F.when(F.size("sections") > 0, F.col("sections")),
    }
    columns = [given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in FIELDS.items()]
    return raw.select("id", "source", *columns, importer(unglue(told)).alias("importer"))
